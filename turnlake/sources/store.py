"""A log-structured store of chat tables: sorted runs of changes over a base, merged when they are read.

A commit writes its files to a folder of its own and then makes them current by putting the next
manifest in place, if none is there: of two writers that started from one version the later one fails, and
nothing that was committed is touched. The manifest names, for each table, its base and the runs since,
each with its sequence number, and carries the highest message id ever given
and the last batch of each stream that was applied.

A run holds new rows, patches (columns that are null don't change) and tombstones, by key. Reading a
table joins its base with the runs folded by key, so what is shuffled, or broadcast where the planner finds it small, is what
changed. Of several patches the one with the highest sequence number, then the latest, counts; a
tombstone holds for good, as ids are never given twice. What hangs on a deleted row goes with it by an anti join, so
deleting a conversation writes one row, whatever the number of its messages. compact() makes the
merged table the new base.

index() adds to each folder of files an index of a column's values, once; find() asks it first and opens only the files that
may hold a key. A folder without one is read whole, so a lookup right after a commit is right too.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnlake.operators import mutations as M
from turnlake.sources import files
from turnlake.sources import schemas as S

#: What a table's files are sorted by, so that reads of one conversation or project skip files and row groups.
SORTED = {"conversations": "project_id", "messages": "conversation_id"}
TABLES = {"projects": S.PROJECTS, "conversations": S.CONVERSATIONS, "messages": S.MESSAGES}
#: The column by which rows hang on another table's.
HANGS = {"conversations": ("project_id", "projects"), "messages": ("conversation_id", "conversations")}


class Conflict(RuntimeError):
    """Another writer committed since; nothing of this commit is visible."""


class Store:
    """Readers keep the version they opened; writers say which version they started from."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        path = self.hadoop.Path(self.root)
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.files = self.hadoop.FileContext.getFileContext(self.fs.getUri(), spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.fs.makeQualified(self.hadoop.Path(f"{self.root}/{name}"))

    def manifest(self, version: int | None = None) -> dict | None:
        """The manifest of a version, or the current one; None where there is none yet."""
        if version is None:
            if not self.fs.exists(self._path("manifests")):
                return None
            names = [p.getPath().getName() for p in self.fs.listStatus(self._path("manifests"))]
            versions = [int(n.removesuffix(".json")) for n in names if n.endswith(".json")]
            if not versions:
                return None
            version = max(versions)
        stream = self.fs.open(self._path(f"manifests/{version:012d}.json"))
        try:
            found = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        if found["schema_version"] > S.SCHEMA_VERSION:
            raise RuntimeError(f"the store has schema version {found['schema_version']}; this code knows {S.SCHEMA_VERSION}")
        return found

    def initialize(self) -> dict:
        """Empty tables and the default project, once, also where several writers try."""
        if found := self.manifest():
            return found
        empty = {n: self.spark.createDataFrame([], s) for n, s in TABLES.items()}
        first = self.spark.sql("SELECT current_timestamp() AS t").first().t
        empty["projects"] = self.spark.createDataFrame([(*S.DEFAULT_PROJECT, first, first)], S.PROJECTS)
        try:
            return self.commit(empty, 0, since=0)
        except Conflict:
            return self.manifest()

    def _written(self, df: DataFrame, name: str, folder: str, ranged: bool = True) -> str:
        """Files sorted by what reads ask for; a base's are dealt by ranges too, a run's stay where their rows are."""
        if by := SORTED.get(name):
            df = (df.repartitionByRange(by, "id") if ranged else df).sortWithinPartitions(by, "id")
        df.write.parquet(f"{self.root}/{folder}/{name}")
        return f"{folder}/{name}"

    def _put(self, now: dict, tables: dict, high_water: int | None, folder: str, applied: dict | None = None) -> dict:
        """Makes these tables current as the version after now, unless another has."""
        version = now["version"] + 1
        new = {"schema_version": S.SCHEMA_VERSION, "version": version, "tables": now["tables"] | tables, "high_water": max(now["high_water"], high_water or 0), "applied": now["applied"] | (applied or {})}
        draft, final = self._path(f"manifests/{uuid.uuid4().hex}.draft"), self._path(f"manifests/{version:012d}.json")
        out = self.fs.create(draft, False)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        keep = self.spark.sparkContext._gateway.new_array(self.hadoop.Options.Rename, 0)  # fails if the target is there
        try:
            self.files.rename(draft, final, keep)
        except Exception as e:
            self.fs.delete(draft, False)
            self.fs.delete(self._path(folder), True)
            if self.fs.exists(final):
                raise Conflict(f"version {version} was written by another") from e
            raise
        return new

    def _since(self, since: int | None) -> dict:
        now = self.manifest() or {"version": 0, "tables": {}, "high_water": 0, "applied": {}}
        if since is not None and since != now["version"]:
            raise Conflict(f"version {now['version']} was written since version {since}")
        return now

    def commit(self, tables: dict[str, DataFrame], high_water: int | None = None, since: int | None = None) -> dict:
        """Whole tables: each becomes the base of its name, without runs; the others stay."""
        now, folder = self._since(since), f"data/{uuid.uuid4().hex}"
        return self._put(now, {n: {"base": self._written(df, n, folder), "runs": []} for n, df in tables.items()}, high_water, folder)

    def append(self, changes: dict[str, DataFrame], high_water: int | None = None, since: int | None = None, applied: dict[str, int] | None = None) -> dict:
        """Changes by table: id, some of its columns, and gone (a tombstone) where given. New rows have all columns.

        applied names the batches of streams that these changes are.
        """
        now, folder = self._since(since), f"data/{uuid.uuid4().hex}"
        tables = {}
        for name, df in changes.items():
            has = set(df.columns)
            row = [F.col(f.name).cast(f.dataType) if f.name in has else F.lit(None).cast(f.dataType).alias(f.name) for f in TABLES[name]]
            gone = F.coalesce("gone", F.lit(False)) if "gone" in has else F.lit(False)
            run = {"path": self._written(df.select(*row, gone.alias("gone")), name, folder, ranged=False), "seq": now["version"] + 1}
            old = now["tables"][name]
            tables[name] = {"base": old["base"], "runs": [*old["runs"], run]}
        return self._put(now, tables, high_water, folder, applied)

    def add_messages(self, new: DataFrame, since: int | None = None) -> dict:
        """Messages (conversation_id, role, content, model_profile, at, nth) with ids that go on from the highest ever given; their conversations move up."""
        now = self._since(since)
        rows, top = M.placed_messages(M.acceptable(new, self.read("conversations", now)), now["high_water"])
        moved = rows.groupBy(F.col("conversation_id").alias("id")).agg(F.max("created_at").alias("updated_at"))
        return self.append({"messages": rows, "conversations": moved}, top, since=now["version"])

    def _part(self, name: str, path: str, schema: T.StructType, only: dict) -> DataFrame:
        """The rows of one folder; of those that only asks for, by its index where it has one."""
        if name not in only:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{path}")
        column, keys = only[name]
        found = self.holding(path, column, keys)
        rows = self.spark.read.schema(schema).parquet(*found) if found else self.spark.createDataFrame([], schema)
        wanted = F.col(column).isin(*keys)
        return rows.where(wanted | F.col("gone") if column != "id" and "gone" in schema.names else wanted)

    def holding(self, path: str, column: str, keys: Sequence) -> list[str]:
        """What of a folder has to be opened to find rows with these keys: files, or all of it where it isn't indexed."""
        if not self.fs.exists(self._path(f"{path}-by-{column}")):
            return [f"{self.root}/{path}"]
        return [r.file for r in files.holding(self.spark.read.parquet(f"{self.root}/{path}-by-{column}"), keys).collect()]

    def index(self, *names: str) -> None:
        """Indexes what the current version has and no index yet: ids, and of a base what it is sorted by."""
        now = self.manifest()
        for name in names or TABLES:
            paths = [(now["tables"][name]["base"], True), *((r["path"], False) for r in now["tables"][name]["runs"])]
            for path, base in paths:
                # a run's tombstones have ids only, so a run is indexed by these
                for column in ["id", SORTED[name]] if base and name in SORTED else ["id"]:
                    if self.fs.exists(self._path(f"{path}-by-{column}")):
                        continue
                    draft = f"{path}-by-{column}-{uuid.uuid4().hex}"
                    files.index_of(self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/{path}"), column).write.parquet(f"{self.root}/{draft}")
                    if not self.fs.rename(self._path(draft), self._path(f"{path}-by-{column}")):
                        self.fs.delete(self._path(draft), True)  # another was first

    def find(self, name: str, keys: Sequence, column: str = "id", now: dict | None = None) -> DataFrame:
        """The rows of a table with these ids (of messages also with these conversation_ids), as read() gives them.

        For as many keys as a caller has at hand: they, and the parents of the rows they name, pass through the driver. For more, join.
        """
        if column != "id" and (name, column) != ("messages", SORTED["messages"]):
            raise ValueError(f"{name} can't be found by {column}")
        now, keys = now or self.manifest(), list(keys)
        if not keys:
            return self.spark.createDataFrame([], TABLES[name])
        only, below, asked = {name: (column, keys)}, name, column
        while below in HANGS:
            foreign, above = HANGS[below]
            ids = keys if asked == foreign else [r[0] for r in self._merged(below, now, only).select(foreign).distinct().collect()]
            only[above] = ("id", ids)
            below, asked = above, "id"
        return self.read(name, now, only)

    def _runs(self, name: str, now: dict, only: dict = {}) -> DataFrame | None:
        runs = [self._part(name, r["path"], _run_schema(name), only).withColumn("seq", F.lit(r["seq"])) for r in now["tables"][name]["runs"]]
        if not runs:
            return None
        both = runs[0]
        for r in runs[1:]:
            both = both.unionByName(r)
        return both

    def _gone(self, name: str, now: dict, only: dict = {}) -> DataFrame | None:
        """The ids of a table's tombstones, and of what hung on another's."""
        runs = self._runs(name, now, only)
        own = runs.where("gone").select("id") if runs is not None else None
        if name in HANGS and (above := self._gone(HANGS[name][1], now, only)) is not None:
            column = HANGS[name][0]
            below = self._merged(name, now, only).join(above.withColumnRenamed("id", column), column, "left_semi").select("id")
            own = below if own is None else own.unionByName(below)
        return own

    def _merged(self, name: str, now: dict, only: dict = {}) -> DataFrame:
        """Base and runs without the tombstones: what is patched by id, and the rows that runs add."""
        columns = [f.name for f in TABLES[name]]
        base = self._part(name, now["tables"][name]["base"], TABLES[name], only)
        runs = self._runs(name, now, only)
        if runs is None:
            return base
        live = runs.where("NOT gone")
        if name == "messages":  # never patched
            return base.unionByName(live.select(*columns))
        # the latest patch of each column; of one commit's the one with the latest time
        when = lambda c: F.struct("seq", F.col("updated_at").alias("_at"), c)
        rest = [c for c in columns if c != "id"]
        folded = live.groupBy("id").agg(*(F.max(F.when(F.col(c).isNotNull(), when(c))).alias(f"_{c}") for c in rest))
        patch = {c: F.col(f"_{c}")[c] for c in rest}
        patched = base.join(folded, "id", "left").select("id", *(F.coalesce(patch[c], F.col(c)).alias(c) for c in rest))
        # a row that no base has was added by a run, which gave it all its columns
        added = folded.where(F.col("_created_at").isNotNull()).join(base.select("id"), "id", "left_anti").select("id", *(patch[c].alias(c) for c in rest))
        return patched.unionByName(added).select(*columns)

    def read(self, name: str, now: dict | None = None, only: dict = {}) -> DataFrame:
        """A table as of a manifest, or of the current one; only is find()'s: by table the column and the keys that matter."""
        now = now or self.manifest()
        found = self._merged(name, now, only)
        runs = self._runs(name, now, only)
        if runs is not None:
            found = found.join(runs.where("gone").select("id"), "id", "left_anti")
        if name in HANGS and (above := self._gone(HANGS[name][1], now, only)) is not None:
            column = HANGS[name][0]
            found = found.join(above.withColumnRenamed("id", column), column, "left_anti")
        return found.select(*(f.name for f in TABLES[name]))

    def compact(self, *names: str) -> dict:
        """The merged tables as new bases. All that hang on a compacted table are compacted with it, since its tombstones go."""
        now = self.manifest()
        chosen = set(names or TABLES)
        for _ in HANGS:
            chosen |= {n for n, (_, above) in HANGS.items() if above in chosen}
        return self.commit({n: self.read(n, now) for n in TABLES if n in chosen}, since=now["version"])


def _run_schema(name: str):
    return T.StructType([*(T.StructField(f.name, f.dataType, True) for f in TABLES[name]), T.StructField("gone", T.BooleanType(), False)])
