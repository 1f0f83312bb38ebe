"""Behaviour of the chat-history engine."""

import datetime as dt
import http.server
import json
import os
import random
import sqlite3
import threading

import pytest
from pyspark.sql import functions as F

from turnlake.functions import text as X
from turnlake.operators import chats as H
from turnlake.operators import flights as V
from turnlake.operators import mutations as M
from turnlake.operators import reads as R
from turnlake.operators import rules as C
from turnlake.plans import catalogue
from turnlake.sources import readers as S
from turnlake.sources import bucketed, remote, schemas, sqlite
from turnlake.sources.store import Conflict, Store
from turnlake.streaming import activity, repaints, replies

SPACES = "".join(chr(c) for c in range(0x110000) if chr(c).isspace())
T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def test_strip_words_and_titles_follow_unicode_white_space(spark):
    texts = ["", " ", SPACES, f"{SPACES}a{SPACES}b", "​ x ﻿", "😀" * 50, "a" * 44, "a" * 45, "b" * 40 + "  c d e f", "x\n\ty", *("w" * k + " tail end of it" for k in range(28, 48))]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.strip(F.col("t")).alias("s"), X.words(F.col("t")).alias("w"), X.title(F.col("t")).alias("title")).collect()
    for r in got:
        one = " ".join(r.t.split())
        assert (r.s, r.w) == (r.t.strip(), r.t.split())
        assert r.title == (one if len(one) <= 44 else one[:41].rstrip() + "...")


def test_profiles_and_settings(spark):
    plain = S.settings(spark, {})
    assert (plain["timeout"], plain["max_tokens"], plain["temperature"], plain["default_profile"]) == (120.0, 1024, 0.2, "lorem")
    assert [r.key for r in plain["profiles"].orderBy("position").collect()] == ["lorem", "default"]
    item = lambda k, **x: {"key": k, "label": k, "base_url": "http://h/v1/", "model": "m", **x}
    two = S.settings(spark, {"CHAT_DEFAULT_PROFILE": "b", "VLLM_PROFILES_JSON": json.dumps([item("a"), item("b")])})
    assert {r.base_url for r in two["profiles"].where("position >= 0").collect()} == {"http://h/v1"}
    for bad in (
        {"VLLM_PROFILES_JSON": json.dumps([item("a"), item("a")])}, {"VLLM_PROFILE_KEY": "lorem"}, {"CHAT_DEFAULT_PROFILE": "gone"}, {"CHAT_DEFAULT_PROFILE": ""}, {"VLLM_PROFILES_JSON": "{}"}, {"VLLM_PROFILES_JSON": "[]"},
        {"VLLM_PROFILES_JSON": "[oops"}, {"VLLM_PROFILES_JSON": json.dumps([item("a", base_url="ftp://x")])}, {"VLLM_TIMEOUT_SECONDS": "0"}, {"VLLM_MAX_TOKENS": "1.5"}, {"VLLM_TEMPERATURE": "nan"},
    ):
        with pytest.raises(ValueError):
            S.settings(spark, bad)


CHANGE = "id string, new_title string, at timestamp"
NEW = "conversation_id string, role string, content string, model_profile string, at timestamp, nth int"
CONVERSATION = "id string, project_id string, title string, model_profile string, created_at timestamp, updated_at timestamp"


def _chat(cid, title="Trip to Oslo", profile="small", minutes=0):
    return (cid, "default", title, profile, at(minutes), at(minutes))


def test_a_lookup_opens_few_files(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.initialize()
    chat = F.format_string("chat %04d", F.col("id") % 500)
    rows = spark.range(20_000).select("id", chat.alias("conversation_id"), F.lit("user").alias("role"), F.concat(F.lit("line "), F.col("id").cast("string")).alias("content"), F.lit(None).cast("string").alias("model_profile"), F.lit(T0).alias("created_at"))
    chats = spark.range(500).select(chat.alias("id"), F.lit("default").alias("project_id"), F.lit("t").alias("title"), F.lit("lorem").alias("model_profile"), F.lit(T0).alias("created_at"), F.lit(T0).alias("updated_at"))
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")
    before = [spark.conf.get(n) for n in names]
    for n, v in zip(names, ("50", "false")):
        spark.conf.set(n, v)
    try:
        store.commit({"messages": rows, "conversations": chats})
    finally:
        for n, v in zip(names, before):
            spark.conf.set(n, v)
    base = store.manifest()["tables"]["messages"]["base"]
    assert store.holding(base, "id", [7]) == [f"{store.root}/{base}"]  # not indexed yet: all of it
    plain = sorted(map(tuple, store.find("messages", [7, 19_999, 55_555]).collect()))
    store.index()
    store.index()
    files = len(spark.read.parquet(f"{store.root}/{base}").inputFiles())
    assert files > 40
    # ids are in no order over the files, so it is the filters that tell; conversations are, and the filters of ids have few false hits
    for keys, column, most in (([7], "id", 3), ([55_555], "id", 2), (["chat 0123"], "conversation_id", 2), (["chat 9999"], "conversation_id", 0)):
        assert len(store.holding(base, column, keys)) <= most < files / 10
    assert sum(len(store.holding(base, "id", [k])) for k in range(5, 20_000, 1_000)) < 20 * 3
    assert sorted(map(tuple, store.find("messages", [7, 19_999, 55_555]).collect())) == plain == sorted(map(tuple, store.read("messages").where("id IN (7, 19999)").collect()))
    assert len(store.find("messages", [7]).inputFiles()) < files / 10
    # what later runs change and delete is seen, with and without their index
    store.append({"messages": spark.createDataFrame([(7, True)], "id long, gone boolean"), "conversations": spark.createDataFrame([("chat 0009", True)], "id string, gone boolean")})
    store.append({"conversations": spark.createDataFrame([("chat 0008", "renamed", at(1))], "id string, title string, updated_at timestamp")})
    for _ in range(2):
        assert [r.id for r in store.find("messages", [7, 8, 9, 509]).collect()] == [8]
        assert store.find("messages", ["chat 0009"], "conversation_id").count() == 0
        assert sorted(r.id for r in store.find("messages", ["chat 0007"], "conversation_id").collect()) == list(range(507, 20_000, 500))
        assert sorted((r.id, r.title) for r in store.find("conversations", ["chat 0008", "chat 0009", "chat 0010", "none"]).collect()) == [("chat 0008", "renamed"), ("chat 0010", "t")]
        store.index()
    assert store.find("projects", ["default", "x"]).count() == 1 and store.find("messages", []).count() == 0
    with pytest.raises(ValueError):
        store.find("conversations", ["default"], "project_id")


def test_a_store_is_seeded_once_and_gated_by_version(spark, tmp_path):
    folder = str(tmp_path / "store")
    assert Store(spark, folder).initialize() == Store(spark, folder).initialize()
    assert [r.id for r in Store(spark, folder).read("projects").collect()] == [schemas.DEFAULT_PROJECT[0]]
    (tmp_path / "store" / "manifests" / f"{7:012d}.json").write_text(json.dumps({"schema_version": schemas.SCHEMA_VERSION + 1, "version": 7, "tables": {}, "high_water": 0}))
    with pytest.raises(RuntimeError):
        Store(spark, folder).initialize()


def test_requests_make_the_same_conversations_however_often_they_are_read(spark):
    none = spark.createDataFrame([_chat("taken")], CONVERSATION)
    projects = spark.createDataFrame([("default",)], "id string")
    asked = [
        ("a", "default", "  Recipes ", "small", at(3)), ("a", "default", "Later", "small", at(4)), ("b", "default", None, "small", at(1)), ("c", "default", "\u2003", "small", at(1)),
        ("d", "default", "x", " ", at(1)), ("e", "elsewhere", "x", "small", at(1)), ("taken", "default", "x", "small", at(1)), ("f", "default", "y", " small ", at(1)),
    ]
    made = M.made_conversations(none, spark.createDataFrame(asked, "id string, project_id string, title string, model_profile string, at timestamp"), projects)
    want = {"a": ("Recipes", "small"), "b": (schemas.DEFAULT_TITLE, "small"), "f": ("y", " small ")}
    for _ in range(2):
        rows = made.collect()
        assert {r.id: (r.title, r.model_profile) for r in rows} == want and all(r.created_at == r.updated_at for r in rows)


def test_of_several_changes_the_latest_counts_and_of_several_defaults_the_first(spark):
    chats = spark.createDataFrame([_chat("a"), _chat("b")], CONVERSATION)
    changes = spark.createDataFrame([("a", " Second ", at(9)), ("a", "First", at(2)), ("a", " ", at(20)), ("x", "nobody", at(1))], CHANGE)
    assert sorted((r.id, r.title, r.updated_at) for r in M.rename(chats, changes).collect()) == [("a", "Second", at(9)), ("b", "Trip to Oslo", at(0))]
    told = M.set_profile(chats, spark.createDataFrame([("b", "large", at(5)), ("b", "small", at(4)), ("b", "", at(8))], "id string, new_profile string, at timestamp"))
    assert sorted((r.id, r.model_profile, r.updated_at) for r in told.collect()) == [("a", "small", at(0)), ("b", "large", at(5))]
    rows = spark.createDataFrame([(1, "one")], "id int, name string")
    defaults = spark.createDataFrame([(2, "zwei", 0), (2, "deux", 1), (1, "uno", 0), (3, "drei", 5)], "id int, name string, nth int")
    assert sorted(tuple(r) for r in M.seed(rows, defaults, order="nth").collect()) == [(1, "one"), (2, "zwei"), (3, "drei")]
    assert {r.id: r.applied for r in M.applied(chats, spark.createDataFrame([("a",), ("x",)], "id string")).collect()} == {"a": True, "x": False}


def test_message_ids_go_on_without_gaps_in_order_of_arrival(spark):
    chats = spark.createDataFrame([_chat("a"), _chat("b")], CONVERSATION)
    none = spark.createDataFrame([], schemas.MESSAGES)
    new = [("a" if n % 3 else "b", "user", f"  note {n} ", None, at(n), n * n) for n in range(300)] + [("a", "narrator", "x", None, at(1), 1), ("b", "user", "\u2003", None, at(1), 2), ("gone", "user", "x", None, at(1), 3)]
    both, moved, top = M.add_messages(none, chats, spark.createDataFrame(new, NEW).repartition(7), 40)
    assert [(r.id, r.content) for r in both.orderBy("id").collect()] == [(41 + n, f"  note {n} ") for n in range(300)]
    assert {r.id: r.updated_at for r in moved.collect()} == {"a": at(299), "b": at(297)} and top == 340
    gone = spark.createDataFrame([("b",)], "conversation_id string")
    left = M.delete(both, gone, "conversation_id")
    assert left.count() == 200 and M.delete(left, gone, "conversation_id").count() == 200


def test_a_stored_history_is_read_again_by_conversation(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.initialize()
    chats = spark.createDataFrame([_chat(f"chat {k:02d}") for k in range(20)], schemas.CONVERSATIONS)
    messages, moved, top = M.add_messages(store.read("messages"), chats, spark.createDataFrame([(f"chat {k % 20:02d}", "user", f"line {k}", None, at(k), k) for k in range(200)], NEW), store.manifest()["high_water"])
    store.commit({"messages": messages, "conversations": moved}, top)
    again = Store(spark, str(tmp_path / "store"))
    one = R.messages_of(again.read("messages"), "chat 07")
    assert "EqualTo(conversation_id,chat 07)" in one._jdf.queryExecution().executedPlan().toString()
    assert [r.content for r in one.collect()] == [f"line {k}" for k in range(7, 200, 20)] and again.manifest()["high_water"] == 200
    assert [r.id for r in R.conversations_of(again.read("conversations"), "default").collect()] == [f"chat {k:02d}" for k in range(19, -1, -1)]
    assert R.conversations_of(again.read("conversations"), "other").count() == 0


def test_equal_places_in_a_batch_are_numbered_by_many_tasks(spark):
    rows = spark.range(20_000).select(F.lit(7).alias("nth"), F.concat(F.lit("c"), (F.col("id") % 3000).cast("string")).alias("conversation_id"), F.lit(at(0)).alias("at"), F.col("id").cast("string").alias("content"))
    assert M.sliced(rows, "nth", "conversation_id", "content").select("slice").distinct().count() > 1
    got = M.numbered(rows, "nth", "conversation_id", "content").orderBy("conversation_id", "content").select("place").collect()
    assert [r.place for r in got] == list(range(1, 20_001))


def _stored(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.initialize()
    store.commit({"conversations": spark.createDataFrame([_chat(c) for c in "abc"], schemas.CONVERSATIONS)})
    return store


def test_a_late_writer_fails_and_the_committed_version_stays(spark, tmp_path, monkeypatch):
    store, late = _stored(spark, tmp_path), Store(spark, str(tmp_path / "store"))
    old = late.manifest()
    store.commit({"conversations": spark.createDataFrame([_chat("kept")], schemas.CONVERSATIONS)})
    evil = spark.createDataFrame([_chat("evil")], schemas.CONVERSATIONS)
    for write in (late.commit, late.append):
        with pytest.raises(Conflict):
            write({"conversations": evil}, since=old["version"])
        with monkeypatch.context() as m:  # it looked before the other one committed
            m.setattr(late, "manifest", lambda *_: old)
            with pytest.raises(Conflict):
                write({"conversations": evil})
    assert [r.id for r in store.read("conversations").collect()] == ["kept"] and store.manifest()["version"] == old["version"] + 1
    assert [r.id for r in store.read("conversations", store.manifest(old["version"])).orderBy("id").collect()] == ["a", "b", "c"]
    assert not [p for p in (tmp_path / "store" / "manifests").iterdir() if p.name.endswith(".draft")]


def test_runs_are_merged_when_read_and_compacted(spark, tmp_path):
    store = _stored(spark, tmp_path)
    patch = lambda rows: spark.createDataFrame(rows, "id string, title string, updated_at timestamp")
    store.append({"conversations": patch([("a", "first", at(1)), ("a", "second", at(2)), ("b", "b1", at(9)), ("nobody", "x", at(1))])})
    store.append({"conversations": patch([("b", "b2", at(3))])})
    new = [(c, "user", f"{c} {k}", None, at(k), k) for k, c in enumerate("abca")] + [("nobody", "user", "x", None, at(1), 9)]
    first = store.add_messages(spark.createDataFrame(new, NEW))
    second = store.add_messages(spark.createDataFrame(new[:1], NEW))
    assert (first["high_water"], second["high_water"]) == (4, 5)
    store.append({"conversations": spark.createDataFrame([_chat("d", "added", minutes=4)], CONVERSATION)})
    store.append({"conversations": spark.createDataFrame([("a", True)], "id string, gone boolean")})
    store.append({"conversations": patch([("a", "too late", at(50)), ("d", "renamed", at(6))])})
    want = [("b", "b2", at(1)), ("c", "Trip to Oslo", at(2)), ("d", "renamed", at(6))]
    for _ in range(2):
        assert sorted((r.id, r.title, r.updated_at) for r in store.read("conversations").collect()) == want
        assert [(r.id, r.content) for r in store.read("messages").orderBy("id").collect()] == [(2, "b 1"), (3, "c 2")]
        store.compact()
    now = store.manifest()
    assert now["high_water"] == 5 and not any(t["runs"] for t in now["tables"].values())
    assert store.add_messages(spark.createDataFrame(new[1:2], NEW))["high_water"] == 6
    store.append({"projects": spark.createDataFrame([("default", True)], "id string, gone boolean")})
    assert store.read("conversations").count() == store.read("messages").count() == 0


def test_a_send_is_admitted_when_the_one_before_has_ended(spark):
    rng = random.Random(2)
    rows = [(c, at(t), None if rng.random() < 0.02 else at(t + rng.randrange(0, 40)), n) for n, (c, t) in enumerate((rng.choice(["hot"] * 5 + ["a", "b", None]), rng.randrange(20_000)) for _ in range(3000))]
    sends = spark.createDataFrame(rows, "conversation_id string, at timestamp, until timestamp, nth int").repartition(5)
    free, want = {}, {}
    for c, t, e, n in sorted((r for r in rows if r[0]), key=lambda r: (r[0], r[1], r[3])):
        if want.setdefault(n, c not in free or (free[c] is not None and t >= free[c])):
            free[c] = e
    got = V.admitted(sends).collect()
    assert {r.nth: r.admitted for r in got} == want and len(got) == len(want)
    periods = V.busy_periods(sends.where("until IS NOT NULL"))
    assert periods.groupBy("conversation_id").agg(F.countDistinct("period").alias("n")).where("conversation_id = 'hot'").first().n > 20
    assert V.admitted(sends.limit(0)).count() == 0


def test_listings_put_the_latest_activity_first(spark):
    rows = spark.createDataFrame([("tea", at(4)), ("salt", at(6)), ("tea", at(7)), ("rye", at(1))], "conversation_id string, created_at timestamp")
    heads = R.heads(rows)
    assert [r.conversation_id for r in R.by_latest(heads).collect()] == ["tea", "salt", "rye"] and R.newest(heads).first().conversation_id == "tea"


PROFILES = [("small", "Small one", "vllm", "http://h", "m"), ("lorem", "Offline", "lorem", None, None), ("bare", "Bare", "vllm", "http://h", "")]
PROFILE = "key string, label string, backend string, base_url string, model string"


def test_pages_open_heal_and_delete(spark):
    profiles = spark.createDataFrame(PROFILES, PROFILE)
    chats = spark.createDataFrame([_chat("a", minutes=5), _chat("b", schemas.DEFAULT_TITLE, "retired", 9), _chat("c", minutes=1)], CONVERSATION)
    pages = spark.createDataFrame([(1, "b", "n1", at(30), "b"), (2, "zz", "n2", at(31), "zz"), (3, "a", "n3", at(32), "c")], "page int, conversation_id string, new_id string, at timestamp, shown string").withColumn("project_id", F.lit("default"))
    other = spark.createDataFrame([("x", "other", "Elsewhere", "small", at(99), at(99))], CONVERSATION)
    assert {(r.page, r.id, r.model_profile) for r in H.opened(chats.unionByName(other), profiles, pages, "lorem").collect()} == {(k, "b", "lorem") for k in (1, 2, 3)}
    assert {(r.page, r.id, r.project_id) for r in H.opened(chats, profiles, pages.withColumn("project_id", F.lit("other")), "lorem").collect()} == {(k, "n1", "other") for k in (1, 2, 3)}
    assert {(r.page, r.id, r.title) for r in H.opened(chats.limit(0), profiles, pages, "lorem").collect()} == {(k, "n1", schemas.DEFAULT_TITLE) for k in (1, 2, 3)}
    assert H.opened(chats.limit(0), profiles, pages.limit(0), "lorem").count() == 0
    assert sorted((r.page, r.id, r.created, r.model_profile) for r in H.healed(chats, profiles, pages, "lorem").collect()) == [(1, "b", False, "lorem"), (2, "n2", True, "lorem"), (3, "a", False, "small")]
    messages = spark.createDataFrame([(1, "a")], "id long, conversation_id string")
    assert sorted((r.page, r.id, r.reused) for r in H.new_chats(chats, messages, pages).collect()) == [(1, "b", True), (2, "n2", False), (3, "n3", False)]
    asked = pages.drop("project_id")
    left, kept, told = H.deleted(chats.unionByName(other), messages, spark.createDataFrame([("a",)], "conversation_id string"), asked, "lorem")
    assert {r.id for r in left.collect()} == {"a", "c", "x"} and kept.count() == 1
    assert sorted((r.page, r.deleted, r.shows) for r in told.collect()) == [(1, True, "a"), (2, False, "zz"), (3, False, "c")]
    # the last one of a project makes way for a new chat, one for all pages that showed it
    last = spark.createDataFrame([(4, "x", "n4", at(40), "x"), (5, "x", "n5", at(41), "x"), (6, "x", "n6", at(39), "c")], asked.schema)
    left, _, told = H.deleted(chats.unionByName(other), messages, messages.select("conversation_id").limit(0), last, "lorem")
    assert sorted((r.page, r.deleted, r.shows) for r in told.collect()) == [(4, True, "n4"), (5, True, "n4"), (6, True, "c")]
    assert [(r.id, r.title, r.model_profile) for r in left.where("project_id = 'other'").collect()] == [("n4", schemas.DEFAULT_TITLE, "lorem")]
    assert C.may_change_model(chats, spark.createDataFrame([("c",)], "conversation_id string"), profiles, spark.createDataFrame([("a", "small"), ("b", "nowhere"), ("c", "small")], "id string, new_profile string")).select("id").collect() == [("a",)]


def test_sends_save_what_was_said_and_received(spark):
    profiles = spark.createDataFrame(PROFILES, PROFILE)
    chats = spark.createDataFrame([_chat("a", schemas.DEFAULT_TITLE), _chat("b"), _chat("c", schemas.DEFAULT_TITLE), _chat("d", profile="bare"), _chat("e", profile="retired"), _chat("f"), _chat("g")], CONVERSATION)
    old = spark.createDataFrame([(3, "c", "user", "earlier", None, at(1))], schemas.MESSAGES)
    rows = [
        ("a", "  what is\n rye?  ", at(10), 1, None, None, None, at(11)), ("a", "too soon", at(10), 2, None, None, None, at(13)), ("a", "again", at(11), 9, None, None, None, None), ("a", "never", at(90), 10, None, None, None, at(91)), ("b", " ", at(10), 3, None, None, None, at(11)), ("c", "and salt?", at(10), 4, 2, None, None, at(11)),
        ("d", "hello", at(10), 5, None, None, None, at(11)), ("e", "offline", at(10), 6, None, "connection", None, at(11)), ("f", "fail", at(10), 7, None, "status", 503, at(11)), ("g", "mute", at(10), 8, None, None, None, at(11)),
    ]
    sends = spark.createDataFrame(rows, "conversation_id string, text string, at timestamp, nth int, stop_at int, error string, status int, replied_at timestamp")
    came = (("a", 1, [" a grain", " for bread \n"]), ("a", 2, ["lost"]), ("a", 9, ["still"]), ("c", 4, ["one ", "two ", "three"]), ("d", 5, ["never read"]), ("e", 6, ["part"]), ("g", 8, [" ", "\n"]))
    deltas = spark.createDataFrame([(c, n, i, x) for c, n, part in came for i, x in enumerate(part)], "conversation_id string, nth int, chunk_index int, delta string")
    sent = H.send(chats, old, profiles, sends, deltas, "lorem", "SP", 10)
    assert {(r.conversation_id, r.nth): r.notice for r in sent.sends.collect()} == {
        ("a", 1): "ok", ("a", 2): "busy", ("a", 9): "ok", ("a", 10): "busy", ("b", 3): "blank", ("c", 4): "stopped, partial reply saved", ("d", 5): "misconfigured Bare", ("e", 6): "unreachable Offline", ("f", 7): "http Small one 503", ("g", 8): "empty Small one",
    }
    stored = [(r.id, r.conversation_id, r.role, r.content, r.model_profile) for r in sent.messages.orderBy("id").collect()]
    assert stored == [
        (3, "c", "user", "earlier", None), (11, "a", "user", "what is\n rye?", None), (12, "a", "assistant", "a grain for bread", "small"), (13, "c", "user", "and salt?", None), (14, "c", "assistant", "one two", "small"),
        (15, "d", "user", "hello", None), (16, "e", "user", "offline", None), (17, "e", "assistant", "part", "lorem"), (18, "f", "user", "fail", None), (19, "g", "user", "mute", None),
        (20, "a", "user", "again", None), (21, "a", "assistant", "still", "small"),
    ]
    assert {r.id: (r.title, r.updated_at) for r in sent.conversations.collect()} == {
        "a": ("what is rye?", at(11)), "b": ("Trip to Oslo", at(0)), "c": (schemas.DEFAULT_TITLE, at(11)), "d": ("Trip to Oslo", at(10)), "e": ("Trip to Oslo", at(11)), "f": ("Trip to Oslo", at(10)), "g": ("Trip to Oslo", at(10)),
    }
    said = {(r.conversation_id, r.nth): [(m["role"], m["content"]) for m in json.loads(r.context)] for r in sent.contexts.collect()}
    assert said["c", 4] == [("system", "SP"), ("user", "earlier"), ("user", "and salt?")] and ("b", 3) not in said
    assert said["a", 1] == [("system", "SP"), ("user", "what is\n rye?")] and said["a", 9] == [*said["a", 1], ("assistant", "a grain for bread"), ("user", "again")]


def test_remote_replies_and_their_errors(spark):
    class Server(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            if asked["model"] == "broken":
                self.send_error(503)
                return
            self.send_response(200)
            self.end_headers()
            for word in (asked["messages"][-1]["content"], " back", f" {asked['max_tokens']}"):
                self.wfile.write(("data: " + json.dumps({"choices": [{"index": 0, "delta": {"content": word}}]}) + "\n\n").encode())
            self.wfile.write(b"data: [DONE]\n\n")

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    here = f"http://127.0.0.1:{server.server_port}"
    profiles = spark.createDataFrame([("s", "S", here, 'm"1'), ("x", "X", here, "broken"), ("off", "Off", "http://127.0.0.1:9", "m")], "key string, label string, base_url string, model string")
    asked = spark.createDataFrame([(k, p, json.dumps([{"role": "user", "content": f"ping {k}"}])) for k, p in enumerate(("s", "x", "off", "s"))], "request long, model_profile string, context string")
    try:
        rows = remote.streamed(remote.requests(asked, profiles, 64, 0.2), "key", 20.0).cache()
        replies_ = R.fold(S.event_stream_deltas(rows.where("line IS NOT NULL")).withColumnRenamed("line_no", "chunk_index"), "request")
        assert {r.request: r.content for r in replies_.collect()} == {0: "ping 0 back 64", 3: "ping 3 back 64"}
        assert {(r.request, r.error, r.status) for r in rows.where("error IS NOT NULL").collect()} == {(1, "status", 503), (2, "connection", None)}
    finally:
        server.shutdown()


def test_a_null_in_a_profile_list_can_count_as_its_text(spark):
    raw = spark.createDataFrame([('[{"key": null, "label": "L", "base_url": "http://h", "model": "m"}, {"label": "L", "base_url": null, "model": "m", "key": "k"}]',)], "json string")
    assert [r.error for r in S.profiles_from_json(raw).orderBy("position").collect()] == ["no key", "no base_url"]
    assert [(r.key, r.error) for r in S.profiles_from_json(raw, null_text=True).orderBy("position").collect()] == [("None", None), ("k", "base_url is no web address")]


def test_lists_and_numbers_are_read_as_strictly_as_they_are_written(spark):
    item = '{"key": "a", "label": "A", "base_url": "http://h", "model": "m", "key": "b"}'
    raws = [f"[{item}]", f" [{item}] \n", f"[{item}] trailing", f"[{item}]]", f"[{item}]}}", f"[{item}], 1", f"[{item}", item, f"[{item}, 3]", f"[{item}, null]", "[]", "", None, f"[{item}] // x"]
    got = [r.l for r in spark.createDataFrame([(r,) for r in raws], "json string").select(S.listed_profiles(F.col("json")).alias("l")).collect()]
    assert [g is not None for g in got] == [True, True] + [False] * 12 and got[0][0].key == "b" and got[0][0].error is None

    def read(kind, x):
        try:
            return kind(x)
        except ValueError:
            return None

    texts = ["12", " 7 ", "\u20037\n", "+3", "1.5", "0", "-2", "1e2", "1E-2", "abc", "", ".", "1.", ".5", "1_000", "1__0", "_1", "1_", "1_.5", "1._5", "30d", "1f", "0x10", "1e", "1e+", "1e1_0", "3000000000", "--1", "+ 1", "1 2", "inf", "-Infinity", "1e400", "infinit"]
    rows = spark.createDataFrame([(x,) for x in texts], "x string").select("x", X.number(F.col("x")).alias("n"), X.whole_number(F.col("x")).alias("w")).collect()
    assert {r.x: (r.n, r.w) for r in rows} == {x: (read(float, x), read(int, x)) for x in texts}
    assert spark.sql("SELECT ' NaN ' AS x").select(X.positive(X.number(F.col("x"))).alias("p"), X.bounded(X.number(F.col("x")), 0, 2).alias("b")).first().b is None


def _fed(spark, folder, batches):
    """Files of deltas, read one a batch in this order."""
    (folder / "in").mkdir()
    for k, rows in enumerate(batches):
        path = folder / "in" / f"{k}.json"
        path.write_text("".join(json.dumps(dict(zip(("conversation_id", "message_seq", "chunk_index", "delta", "kind"), r))) + "\n" for r in rows))
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema("conversation_id string, message_seq long, chunk_index int, delta string, kind string").option("maxFilesPerTrigger", 1).json(str(folder / "in"))
    query = replies.collected(replies.told(stream), str(folder))
    query.awaitTermination()
    got = spark.read.schema("conversation_id string, message_seq long, content string, stopped boolean").parquet(str(folder / "out"))
    return sorted(map(tuple, got.collect())), query.lastProgress["stateOperators"][0]["numRowsTotal"]


def test_replies_are_told_once_and_their_state_goes(spark, tmp_path):
    part = lambda m, i: ("c", m, i, f"{m}.{i} ", "delta")
    batches = [
        [part(1, 1), part(2, 0), part(3, 0), part(4, 2), ("c", 5, 0, None, "end")], [part(1, 0), ("c", 1, 2, None, "end"), ("c", 2, 1, None, "stop"), part(4, 0)],
        [part(2, 1), part(3, 2), ("c", 3, 9, None, "stop"), ("c", 4, 1, None, "stop")], [("c", 2, 3, None, "end"), part(2, 2), ("c", 3, 3, None, "end"), part(3, 1), part(4, 1), ("c", 4, 3, None, "end")],
    ]
    got, left = _fed(spark, tmp_path, batches)
    assert got == [("c", 1, "1.0 1.1 ", False), ("c", 2, "2.0 ", True), ("c", 3, "3.0 3.1 3.2 ", False), ("c", 4, "4.0 ", True), ("c", 5, "", False)]
    assert left == 0


def test_repaints_on_a_stream_wait_for_the_gap(spark, tmp_path):
    (tmp_path / "in").mkdir()
    random.seed(5)
    times = {c: sorted(random.sample(range(0, 4_000), 60)) for c in ("a", "b")} | {"c": [1_500, 1_500, 1_539, 1_540]}
    # four batches of a second each, shuffled within; b is not heard of in the last two, so that a timer has to wake it
    times["b"] = [t for t in times["b"] if t < 2_000]
    for k in range(5):
        rows = [(c, t) for c, ts in times.items() for t in ts if t // 1_000 == k] if k < 4 else [("end", 60_000)]
        random.shuffle(rows)
        path = tmp_path / "in" / f"{k}.json"
        path.write_text("".join(json.dumps({"conversation_id": c, "created_at": (T0 + dt.timedelta(milliseconds=t)).isoformat() + "Z"}) + "\n" for c, t in rows) + '{"conversation_id": "a"}\n')
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema("conversation_id string, created_at timestamp").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = replies.collected(repaints.repaints(stream, 40_000, "1 second"), str(tmp_path))
    query.awaitTermination()
    got = spark.read.schema("conversation_id string, nth long, us long").parquet(str(tmp_path / "out"))
    start, want = int(T0.replace(tzinfo=dt.timezone.utc).timestamp() * 1e6), []
    for c, ts in times.items():
        last, nth = ts[0], 0
        want.append((c, 0, start + last * 1_000))
        for t in ts:
            if t - last >= 40:
                last, nth = t, nth + 1
                want.append((c, nth, start + t * 1_000))
    assert sorted(map(tuple, got.where("conversation_id <> 'end'").collect())) == sorted(want)


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.initialize()
    apply = activity.upsert(store, "feed", "lorem")
    rows = lambda *x: spark.createDataFrame([(c, at(m)) for c, m in x], "conversation_id string, created_at timestamp")
    for number, batch in ((0, rows(("a", 5), ("a", 9), ("b", 3))), (1, rows(("a", 2), ("c", 4))), (0, rows(("a", 500))), (1, rows(("a", 501))), (2, rows(("b", 8)))):
        apply(batch, number)
    assert sorted((r.id, r.created_at, r.updated_at, r.title) for r in store.read("conversations").collect()) == [("a", at(2), at(9), "New chat"), ("b", at(3), at(8), "New chat"), ("c", at(4), at(4), "New chat")]
    assert store.manifest()["applied"] == {"feed": 2}


def test_a_stream_is_stopped_on_request_only(spark, tmp_path):
    (tmp_path / "in").mkdir()
    line = {"conversation_id": "c", "message_seq": 1, "chunk_index": 0, "delta": "x"}
    (tmp_path / "in" / "0.json").write_text(json.dumps(line))
    stop = threading.Event()
    endless = replies.folded(replies.deltas(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("endless").option("checkpointLocation", str(tmp_path / "cp")).start()
    stop.set()
    assert replies.finished(endless, stop) == "stopped" and not endless.isActive
    broken = replies.deltas(spark, str(tmp_path / "in")).selectExpr("raise_error('broken') AS x").writeStream.format("memory").queryName("broken").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="broken"):
        replies.finished(broken, threading.Event())


def test_rules_find_planted_violations(spark):
    rows = spark.createDataFrame([(1, "user", "a", "p"), (2, "tool", " ", "q"), (2, None, None, None)], "id int, role string, content string, parent string")
    assert C.bad_roles(rows).count() == 2 and C.blank(rows, "content").count() == 2 and C.missing(rows, "id", "role").count() == 1
    assert [r.n for r in C.repeated(rows, "id").collect()] == [2]
    parents = spark.createDataFrame([("p",)], "key string")
    assert [r.parent for r in C.orphans(rows, parents, "parent", "key").collect()] == ["q"]


def test_replies_fold_stop_and_read_from_lines(spark):
    asked = spark.createDataFrame([("c", 7)], "conversation_id string, id long")
    assert R.fold(S.offline_replies(asked), "id").first().content == S.OFFLINE_REPLY
    assert S.offline_replies(asked).count() == 19
    words = S.reply_words(spark.createDataFrame([("c", 1, "one  two three"), ("c", 2, "  ")], "conversation_id string, id long, content string"))
    cut = R.stopped(words, F.lit(2), "conversation_id", "id").collect()
    assert [(r.id, r.content) for r in cut] == [(1, "one two")]
    assert R.stopped(words, F.lit(0), "conversation_id", "id").count() == 0
    chunk = lambda *c: "data: " + json.dumps({"choices": [{"index": 0, "delta": {"content": x}} for x in c]})
    lines = ["", chunk("Rye is "), chunk(), chunk(None), chunk(""), chunk("a grain"), "data: [DONE]", "data: {broken"]
    frame = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "request int, line_no int, line string")
    assert [r.delta for r in S.event_stream_deltas(frame).orderBy("line_no").collect()] == ["Rye is ", "a grain"]


def test_a_hot_conversation_is_folded_in_many_tasks(spark):
    # 30,000 of 30,031 messages are one conversation's
    rows = spark.range(30_031).select(F.when(F.col("id") < 30_000, "hot").otherwise(F.concat(F.lit("c"), (F.col("id") % 7).cast("string"))).alias("conversation_id"), (F.col("id") * 7919 % 30_031).alias("id"), F.lit("user").alias("role"), F.concat(F.lit('say "'), F.col("id").cast("string")).alias("content"))
    names = ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")
    before = [spark.conf.get(n) for n in names]
    for n, v in zip(names, ("false", "16")):  # so that small slices are not put together
        spark.conf.set(n, v)
    try:
        got = R.with_turns(rows).withColumn("part", F.spark_partition_id()).where("conversation_id = 'hot'").agg(F.countDistinct("part").alias("parts"), F.countDistinct("turn_no").alias("n"), F.min("turn_no").alias("a"), F.max("turn_no").alias("b")).first()
    finally:
        for n, v in zip(names, before):
            spark.conf.set(n, v)
    assert got.parts > 4 and (got.n, got.a, got.b) == (30_000, 0, 29_999)
    slices = M.sliced(rows, "conversation_id", "id").where("conversation_id = 'hot'").groupBy("slice").count().collect()
    assert max(r["count"] for r in slices) < 15_000
    pieces = R.context_pieces(rows, 100, "SP")
    assert pieces.agg(F.max(F.length("context"))).first()[0] < 100 * 60
    whole = {r.conversation_id: r.context for r in R.contexts(rows, "SP").collect()}
    assert {r.conversation_id: r.context for r in R.joined(pieces, "conversation_id", text="context", most=10**9).collect()} == whole
    short = {r.conversation_id: (r.length, r.context) for r in R.joined(pieces, "conversation_id", text="context", most=10_000).collect()}
    assert short == {k: (len(v), v if k != "hot" else None) for k, v in whole.items()}
    deltas = rows.select("conversation_id", F.col("id").alias("chunk_index"), F.col("content").alias("delta"))
    folded = R.joined(R.reply_pieces(deltas, "conversation_id", size=128), "conversation_id", text="content", most=10**9)
    assert {r.conversation_id: r.content for r in folded.collect()} == {r.conversation_id: r.content for r in R.fold(deltas, "conversation_id").collect()}
    none = rows.where("id < 0")
    assert R.context_pieces(none, 100).count() == R.joined(R.reply_pieces(none.select("conversation_id", F.col("id").alias("chunk_index"), F.col("content").alias("delta")), "conversation_id", size=8), "conversation_id", text="content", most=9).count() == 0


def test_cutting_the_text_at_the_ends_gives_what_is_painted(spark):
    rows = spark.createDataFrame([("c", 1, "Rye "), ("c", 3, ""), ("c", 2, "😀 is"), ("d", 1, "x")], "conversation_id string, id long, content string")
    whole = R.fold(rows.withColumnRenamed("content", "delta"), "conversation_id", order="id")
    cut = R.ends(rows).join(whole, "conversation_id").select("conversation_id", "id", F.col("content").substr(F.lit(1), F.col("end").cast("int")).alias("painted"))
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, R.running(rows).collect()))


def test_paints_wait_for_the_gap_since_the_last_paint(spark):
    times = [0, 10, 39, 40, 41, 79, 80, 200]
    rows = spark.createDataFrame([("c", T0 + dt.timedelta(milliseconds=t)) for t in times], "conversation_id string, created_at timestamp")
    last, want = times[0], 0
    for t in times:
        if t - last >= 40:
            last, want = t, want + 1
    assert R.paints(rows, 40_000).first().paints == want


def test_streaming_twins_equal_batch(spark, tmp_path):
    folder = tmp_path / "deltas"
    folder.mkdir()
    rows = [("c", 1, i, f"{w} ") for i, w in enumerate("the quick brown fox".split())] + [("d", 2, 0, "x")]
    for k in (0, 1):
        (folder / f"{k}.json").write_text("".join(json.dumps(dict(zip(("conversation_id", "message_seq", "chunk_index", "delta"), r))) + "\n" for r in rows[k::2]))
    q = replies.start(replies.folded(replies.deltas(spark, str(folder))), "folded_replies", str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = {(r.conversation_id, r.message_seq): r.content for r in spark.table("folded_replies").collect()}
    assert got == {("c", 1): "the quick brown fox ", ("d", 2): "x"}


def test_device_list(spark, tmp_path):
    (tmp_path / "gpus.csv").write_text("A, 40960\nB, 81920\n")
    assert S.devices(spark, str(tmp_path / "gpus.csv")).agg(F.min("memory_mib")).first()[0] == 40960


def test_sqlite_files_are_written_and_read_by_ranges(spark, tmp_path):
    folder = str(tmp_path / "files")
    rows = spark.range(0, 5_000, 1, 3).select("id", F.when(F.col("id") % 10 > 0, F.concat(F.lit("c\""), (F.col("id") % 10).cast("string"))).alias("conversation id"), (F.col("id") / 3).alias("x"), (F.col("id") % 2 == 0).alias("even"), F.encode(F.col("id").cast("string"), "UTF-8").alias("raw"))
    sqlite.write(rows, folder, "messages", "id")
    sqlite.write(rows.where("id < 0").coalesce(1), folder, "messages", "id")
    (tmp_path / "files" / "left.draft").write_text("of a lost executor")
    assert len([p for p in (tmp_path / "files").iterdir() if p.suffix == ".sqlite"]) == 4
    back = sqlite.read(spark, f"file:{folder}", "messages", rows.schema, splitBytes=16_384)
    assert back.rdd.getNumPartitions() > 4
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    for test in ("id >= 4990", "`conversation id` = 'c\"3'", "`conversation id` IS NULL AND id < 50", "id IN (3, 4, 77777)", "even AND id < 9", "x < 1.5", "`conversation id` > 'c\"7' OR id = 0", "`conversation id` <=> NULL AND id > 4900"):
        assert sorted(r.id for r in back.where(test).collect()) == sorted(r.id for r in rows.where(test).collect())
    # the filter is SQLite's: what the source itself gives is filtered
    reader = sqlite.Reader(rows.schema, {"path": folder, "table": "messages"})
    reader.pushFilters([sqlite.D.EqualTo(("conversation id",), "c\"3"), sqlite.D.LessThan(("id",), 100), sqlite.D.LessThan(("x",), 2.0)])
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 10
    assert sqlite.read(spark, folder, "messages", "id long").agg(F.sum("id")).first()[0] == sum(range(5_000))
    (tmp_path / "none").mkdir()
    assert sqlite.read(spark, str(tmp_path / "none"), "messages", "id long").count() == 0
    with pytest.raises(Exception, match="opened by path"):
        sqlite.read(spark, "hdfs://x/y", "messages", "id long").collect()
    with pytest.raises(Exception, match="no SQLite type"):
        sqlite.write(spark.sql("SELECT current_date() AS d"), folder, "days")


def test_a_sqlite_history_is_opened(spark, tmp_path):
    file, time = tmp_path / "history.db", "2024-01-01T10:00:00.000005+02:00"
    with sqlite3.connect(file) as db:
        db.execute("CREATE TABLE projects (id TEXT PRIMARY KEY, name TEXT, created_at TEXT, updated_at TEXT)")
        db.execute("CREATE TABLE conversations (id TEXT PRIMARY KEY, project_id TEXT, title TEXT, model_profile TEXT, created_at TEXT, updated_at TEXT)")
        db.execute("CREATE TABLE messages (id INTEGER PRIMARY KEY, conversation_id TEXT, role TEXT, content TEXT, model_profile TEXT, created_at TEXT)")
        db.execute("INSERT INTO projects VALUES ('default', 'General', ?, ?)", (time, time))
        db.execute("INSERT INTO conversations VALUES ('c', 'default', 'T', 'lorem', ?, ?)", (time, time))
        db.executemany("INSERT INTO messages VALUES (?, 'c', 'user', ?, NULL, ?)", [(2, "b", time), (1, "a 😀", time)])
        db.execute(f"PRAGMA user_version = {schemas.SCHEMA_VERSION}")
    tables = sqlite.history(spark, str(file))
    assert {n: t.columns for n, t in tables.items()} == {n: s.names for n, s in (("projects", schemas.PROJECTS), ("conversations", schemas.CONVERSATIONS), ("messages", schemas.MESSAGES))}
    assert [(r.id, r.content, r.created_at) for r in R.messages_of(tables["messages"], "c").collect()] == [(1, "a 😀", dt.datetime(2024, 1, 1, 8, 0, 0, 5)), (2, "b", dt.datetime(2024, 1, 1, 8, 0, 0, 5))]
    store = Store(spark, str(tmp_path / "store"))
    store.initialize()
    store.commit(tables, 2)
    assert store.read("messages").count() == 2
    with sqlite3.connect(file) as db:
        db.execute(f"PRAGMA user_version = {schemas.SCHEMA_VERSION + 1}")
    with pytest.raises(Exception, match="has version"):
        sqlite.history(spark, str(file))["messages"].collect()


def test_bucketed_joins_move_nothing(spark):
    parents = spark.range(1_000).select("id", (F.col("id") * 2).alias("title"))
    key = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.col("id") % 1_100).cast("long")
    children = spark.range(9_000).select(key.alias("parent"), F.col("id").alias("message"))
    pair = bucketed.together(parents, children, "id", "parent", 6)
    for got, want in (
        (pair.orphans(), C.orphans(children, parents, "parent", "id")),
        (pair.without_children_of("id % 10 = 7"), M.delete(children, parents.where("id % 10 = 7").select(F.col("id").alias("parent")), "parent")),
        (pair.joined(), children.join(parents.withColumnRenamed("id", "parent"), "parent")),
    ):
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    # the hot parent's 3,000 children are not one bucket's
    sizes = [r["count"] for r in pair.children.groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 9_000 and max(sizes) < 3_000 and pair.parents.where("id = 7").count() > 1
    none = bucketed.together(parents.where("id < 0"), children.where("message < 0"), "id", "parent", 3)
    assert none.orphans().count() == none.joined().count() == 0
    with pytest.raises(ValueError):
        bucketed.together(parents.withColumn("salt", F.lit(1)), children, "id", "parent", 3)


def test_schemas_are_explicit():
    assert [f.name for f in schemas.MESSAGES if f.nullable] == ["model_profile"]


def test_throttled_paints_query_counts_like_a_loop(spark):
    d = "/root/testdata/sf0.001"
    got = {r.conversation_id: r.paints for r in catalogue.QUERIES["throttled_paints"](spark, d).collect()}
    want = {}
    for u, ts in spark.read.parquet(f"{d}/events.parquet").select("user_id", F.unix_micros(F.col("ts").cast("timestamp"))).orderBy("user_id", "ts").collect():
        last, n = want.get(u, (ts, 0))
        want[u] = (ts, n + 1) if ts - last >= 6 * 3_600_000_000 else (last, n)
    assert got == {u: n for u, (_, n) in want.items()}
