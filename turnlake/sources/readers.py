"""Sources: fixture tables as chat tables, profile lists, event-stream lines, device lists, the offline reply."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.functions import text as X
from turnlake.sources import schemas as S

# The offline profile, its reply, and the defaults of the settings.
OFFLINE = ("lorem", "Lorem Ipsum (offline)", "lorem", None, None)
OFFLINE_REPLY = "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua."
DEFAULTS = {
    "VLLM_TIMEOUT_SECONDS": "120", "VLLM_MAX_TOKENS": "1024", "VLLM_TEMPERATURE": "0.2", "VLLM_API_KEY": "not-needed",
    "VLLM_SYSTEM_PROMPT": "You are a helpful assistant. Give clear, accurate, and concise answers.",
    "VLLM_MODEL": "qwen3-0.6b", "VLLM_PROFILE_KEY": "default", "VLLM_BASE_URL": "http://127.0.0.1:8000/v1",
}


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations table as messages: ids rise within a conversation."""
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("conversation_id"), "turn", "role", F.col("text").alias("content"))


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as messages of conversations (a user each)."""
    t = spark.read.parquet(f"{sf_dir}/events.parquet")
    return t.select(F.col("event_id").alias("id"), F.col("user_id").alias("conversation_id"), F.col("ts").cast("timestamp").alias("created_at"), "props")


def json_list(raw: Column) -> Column:
    """The objects of a JSON list as maps; null where the text is anything else, has more after the list, or has other items.

    Parsers stop at the end of the list, so it is read inside a list and inside an object: what follows it
    spoils one of these.
    """
    text = X.strip(raw)
    alone = (F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1) & F.get_json_object(F.concat(F.lit('{"a":'), text, F.lit("}")), "$.a").isNotNull()
    items = F.when(text.startswith("[") & alone, F.from_json(text, "array<map<string,string>>"))
    return F.when(~F.exists(items, lambda m: m.isNull()), items)


def listed_profiles(raw: Column, null_text: bool = False) -> Column:
    """The profiles of a JSON list in order, as structs with position and error; null where it isn't a list of any.

    Of a key that an item has twice the last counts. JSON null counts as missing, or with null_text as the text None.
    """

    def item(p: Column, i: Column) -> Column:
        def field(c: str) -> Column:
            # the last of the item's entries of this name: (value) or nothing
            found = F.try_element_at(F.filter(F.map_entries(p), lambda e: e["key"] == c), F.lit(-1))
            value = F.coalesce(found["value"], F.when(found.isNotNull(), F.lit("None"))) if null_text else found["value"]
            return X.without_slashes(value) if c == "base_url" else X.strip(value)

        made = {c: field(c) for c in ("key", "label", "base_url", "model")}
        return F.struct(
            made["key"].alias("key"), made["label"].alias("label"), F.lit("vllm").alias("backend"), made["base_url"].alias("base_url"), made["model"].alias("model"), i.alias("position"), profile_error(made).alias("error")
        )

    items = json_list(raw)
    return F.when(F.size(items) > 0, F.transform(items, item))


def profiles_from_json(raw: DataFrame, null_text: bool = False) -> DataFrame:
    """From raw (json, and columns that are kept): key, label, backend, base_url, model, position and error for each listed profile.

    A list that can't be read gives one row with an error.
    """
    kept = [c for c in raw.columns if c != "json"]
    listed = raw.select(*kept, listed_profiles(F.col("json"), null_text).alias("items"))
    bad = listed.where(F.col("items").isNull()).select(
        *kept, *(F.lit(None).cast("string").alias(c) for c in ("key", "label", "backend", "base_url", "model")), F.lit(None).cast("int").alias("position"), F.lit(NO_LIST).alias("error")
    )
    return listed.select(*kept, F.explode("items").alias("p")).select(*kept, "p.*").unionByName(bad)


NO_LIST = "the profile list holds no items"


def profile_error(fields: Mapping[str, Column]) -> Column:
    """What is wrong with a profile's fields; null if nothing is."""
    wrong = F.lit(None).cast("string")
    for c in reversed(("key", "label", "base_url", "model")):
        wrong = F.when(fields[c].isNull(), F.lit(f"no {c}")).when(fields[c] == "", F.lit(f"blank {c}")).otherwise(wrong)
    scheme = fields["base_url"].startswith("http://") | fields["base_url"].startswith("https://")
    return F.coalesce(wrong, F.when(~scheme, F.lit("base_url is no web address")))


def with_offline(profiles: DataFrame, *by: str) -> DataFrame:
    """The offline profile first, in each list that by tells apart."""
    offline = [F.lit(v).cast("string").alias(c) for c, v in zip(("key", "label", "backend", "base_url", "model"), OFFLINE)]
    lists = profiles.select(*by).distinct() if by else profiles.sparkSession.range(1).select()
    return lists.select(*by, *offline, F.lit(-1).alias("position"), F.lit(None).cast("string").alias("error")).unionByName(profiles)


def duplicate_keys(profiles: DataFrame, *by: str) -> DataFrame:
    return profiles.groupBy(*by, "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def profile_options(profiles: DataFrame, *by: str) -> DataFrame:
    return profiles.groupBy(*by).agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("position", "key", "label"))), lambda p: F.struct(p["key"], p["label"]))).alias("options"))


def settings_of(environs: DataFrame) -> DataFrame:
    """The settings of environments (env: a map of texts) as columns, and error: what is wrong first; null if nothing is.

    A name that is absent has its default, an empty text is a value; a blank profile list means the one
    profile of the other names.
    """
    e = F.col("env")
    model = X.strip(X.present(e, "VLLM_MODEL", default=DEFAULTS["VLLM_MODEL"]))
    one = {
        "key": X.strip(X.present(e, "VLLM_PROFILE_KEY", default=DEFAULTS["VLLM_PROFILE_KEY"])), "label": X.strip(F.coalesce(e["VLLM_PROFILE_LABEL"], model)),
        "base_url": X.without_slashes(X.present(e, "VLLM_BASE_URL", default=DEFAULTS["VLLM_BASE_URL"])), "model": model,
    }
    single = F.array(F.struct(one["key"].alias("key"), one["label"].alias("label"), F.lit("vllm").alias("backend"), one["base_url"].alias("base_url"), one["model"].alias("model"), F.lit(0).alias("position"), profile_error(one).alias("error")))
    raw = X.present(e, "VLLM_PROFILES_JSON", default="")
    offline = F.array(F.struct(*(F.lit(v).cast("string").alias(c) for c, v in zip(("key", "label", "backend", "base_url", "model"), OFFLINE)), F.lit(-1).alias("position"), F.lit(None).cast("string").alias("error")))
    read = environs.select("*", F.when(X.is_blank(raw), single).otherwise(listed_profiles(raw)).alias("listed"))
    get = lambda k: X.present(e, k, default=DEFAULTS[k])
    told = read.select(
        *environs.columns,
        F.concat(offline, F.coalesce("listed", F.array())).alias("profiles"), F.col("listed").isNull().alias("unread"),
        X.strip(X.present(e, "CHAT_DEFAULT_PROFILE", "VLLM_DEFAULT_PROFILE", default=OFFLINE[0])).alias("default_profile"),
        X.positive(X.number(get("VLLM_TIMEOUT_SECONDS"))).alias("timeout"), X.positive(X.whole_number(get("VLLM_MAX_TOKENS"))).alias("max_tokens"), X.bounded(X.number(get("VLLM_TEMPERATURE")), 0.0, 2.0).alias("temperature"),
        get("VLLM_API_KEY").alias("api_key"), X.strip(get("VLLM_SYSTEM_PROMPT")).alias("system_prompt"), F.nullif(e["CHAT_DB_PATH"], F.lit("")).alias("database"),
    )
    keys = F.transform("profiles", lambda p: p["key"])
    wrong = F.filter("profiles", lambda p: p["error"].isNotNull())
    error = (
        F.when(F.col("unread"), F.lit(NO_LIST))
        .when(F.size(wrong) > 0, F.concat(F.lit("profile "), F.get(wrong, F.lit(0))["position"].cast("string"), F.lit(": "), F.get(wrong, F.lit(0))["error"]))
        .when(F.size(F.array_distinct(keys)) < F.size(keys), F.lit("a profile key comes twice"))
        .when(~F.array_contains(keys, F.col("default_profile")), F.lit("the default profile is not a configured one"))
    )
    for name in ("timeout", "max_tokens", "temperature"):
        error = error.when(F.col(name).isNull(), F.lit(f"{name} is out of range"))
    return told.withColumn("error", error).drop("unread")


def settings(spark: SparkSession, environ: Mapping[str, str]) -> dict:
    """The validated settings of one environment, in one job; raises ValueError where a value is out of its domain."""
    found = settings_of(spark.createDataFrame([(dict(environ),)], "env map<string,string>")).drop("env").first().asDict()
    if error := found.pop("error"):
        raise ValueError(error)
    rows = [tuple(p) for p in found["profiles"]]
    return {**found, "profiles": spark.createDataFrame(rows, "key string, label string, backend string, base_url string, model string, position int, error string")}


def event_stream_deltas(lines: DataFrame) -> DataFrame:
    """From lines (request, line_no, line) of an event stream: the non-empty text deltas in order."""
    chunk = F.from_json(F.substring("line", 7, 1 << 30), S.CHUNK)
    told = lines.where(F.col("line").startswith("data: ") & (F.col("line") != "data: [DONE]"))
    return told.select("request", "line_no", F.get(chunk["choices"], F.lit(0))["delta"]["content"].alias("delta")).where("delta IS NOT NULL AND delta <> ''")


def reply_words(replies: DataFrame) -> DataFrame:
    """conversation_id, id, chunk_index, delta: a reply's words, the second and later ones after a space."""
    split = replies.select("conversation_id", "id", F.posexplode(X.words(F.col("content"))).alias("chunk_index", "word"))
    return split.select("conversation_id", "id", "chunk_index", F.when(F.col("chunk_index") == 0, F.col("word")).otherwise(F.concat(F.lit(" "), "word")).alias("delta"))


def offline_replies(asked: DataFrame) -> DataFrame:
    """The offline profile's reply to each of asked (conversation_id, id), word by word."""
    return reply_words(asked.select("conversation_id", "id", F.lit(OFFLINE_REPLY).alias("content")))


def append_log(rows: DataFrame, path: str) -> None:
    """Log lines (at, message) added to a folder of text files, each task's in one of its own, in order of time within it."""
    rows.sortWithinPartitions("at").select(X.log_line(F.col("at"), F.col("message"))).write.mode("append").text(path)


def devices(spark: SparkSession, path: str) -> DataFrame:
    """A device list: name and memory without header or unit; of a folder with a list for each node=..., node too."""
    return spark.read.schema("name string, memory_mib int").csv(path, header=False, ignoreLeadingWhiteSpace=True)
