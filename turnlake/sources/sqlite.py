"""SQLite files as a source and a sink: a partition reads a range of one file's row ids, a task writes a file of its own.

What Spark filters by is part of each range's query, so SQLite uses its indexes; Spark checks the rows again. Only the columns
of the given schema are read. Files lie in a folder (or are one file) that driver and executors open by path. A file becomes visible, by renaming,
when all tasks have written theirs; drafts of lost executors are never read.
"""

from __future__ import annotations

import os
import sqlite3
import uuid
from collections.abc import Iterable, Iterator
from contextlib import closing
from dataclasses import dataclass
from pathlib import Path
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnlake.functions import text as X
from turnlake.sources import schemas as S

SUFFIXES = (".sqlite", ".sqlite3", ".db")
KINDS = {T.LongType: "INTEGER", T.IntegerType: "INTEGER", T.BooleanType: "INTEGER", T.DoubleType: "REAL", T.StringType: "TEXT", T.BinaryType: "BLOB"}
ARROW = {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.BooleanType: pa.bool_(), T.DoubleType: pa.float64(), T.StringType: pa.string(), T.BinaryType: pa.binary()}
COMPARED = {D.EqualTo: "=", D.EqualNullSafe: "IS", D.GreaterThan: ">", D.GreaterThanOrEqual: ">=", D.LessThan: "<", D.LessThanOrEqual: "<="}
ROWS = 8192  # in a batch


def local(path: str) -> str:
    """A path as files are opened by; other schemes than file have none."""
    if "://" in path.removeprefix("file://"):
        raise ValueError(f"SQLite files are opened by path, not at {path}")
    return path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")


def named(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _opened(file: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{quote(file)}?mode=ro", uri=True)


@dataclass
class Range(D.InputPartition):
    """One of count equal ranges of a file's row ids."""

    file: str
    nth: int
    count: int


class Reader(D.DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.path, self.table = schema, local(options["path"]), options["table"]
        self.split = int(options.get("splitbytes", 128 << 20))
        self.newest = int(options.get("maxversion", 1 << 31))
        self.tests, self.values = [], []
        if bad := [f.name for f in schema if type(f.dataType) not in ARROW]:
            raise ValueError(f"no SQLite type for {bad}")

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        kinds = {f.name: type(f.dataType) for f in self.schema}
        for f in filters:
            # kinds that SQLite orders as Spark does: whole numbers, and texts by their bytes
            if len(f.attribute if hasattr(f, "attribute") else ()) != 1 or kinds.get(f.attribute[0]) not in (T.LongType, T.IntegerType, T.StringType):
                continue
            column = named(f.attribute[0])
            if type(f) in COMPARED:
                self.tests.append(f"{column} {COMPARED[type(f)]} ?")
                self.values.append(f.value)
            elif isinstance(f, D.In) and len(f.value) <= 500:
                self.tests.append(f"{column} IN ({', '.join('?' * len(f.value))})")
                self.values.extend(f.value)
            elif isinstance(f, (D.IsNull, D.IsNotNull)):
                self.tests.append(f"{column} IS {'NOT ' if isinstance(f, D.IsNotNull) else ''}NULL")
        return filters

    def partitions(self) -> list[Range]:
        path = Path(self.path)
        found = sorted(p for p in path.iterdir() if p.suffix in SUFFIXES) if path.is_dir() else [path]
        if not path.exists():
            raise FileNotFoundError(self.path)
        return [Range(str(p), i, n) for p in found for n in [p.stat().st_size // self.split + 1] for i in range(n)]

    def read(self, part: Range | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # a folder without files
            return
        with closing(_opened(part.file)) as db:
            if (version := db.execute("PRAGMA user_version").fetchone()[0]) > self.newest:
                raise RuntimeError(f"{part.file} has version {version}; this code knows {self.newest}")
            tests, values = list(self.tests), list(self.values)
            if part.count > 1:
                least, greatest = db.execute(f"SELECT min(rowid), max(rowid) FROM {named(self.table)}").fetchone()
                if least is None:
                    return
                cut = lambda i: least + (greatest - least + 1) * i // part.count
                tests.append("rowid >= ? AND rowid < ?")
                values += [cut(part.nth), cut(part.nth + 1)]
            columns = ", ".join(named(f.name) for f in self.schema) or "1"
            rows = db.execute(f"SELECT {columns} FROM {named(self.table)}" + (f" WHERE {' AND '.join(tests)}" if tests else ""), values)
            kinds = [(f.name, ARROW[type(f.dataType)]) for f in self.schema]
            while some := rows.fetchmany(ROWS):
                told = [pa.array([bool(v) if kind == pa.bool_() and v is not None else v for v in column], kind) for column, (_, kind) in zip(zip(*some), kinds)]
                yield pa.RecordBatch.from_arrays(told, schema=pa.schema(kinds))


@dataclass
class Written(D.WriterCommitMessage):
    draft: str


class Writer(D.DataSourceArrowWriter):
    def __init__(self, schema: T.StructType, options: dict, overwrite: bool):
        if overwrite:
            raise ValueError("SQLite files are added to a folder, not written over")
        self.schema, self.path, self.table, self.key = schema, local(options["path"]), options["table"], options.get("key")
        if bad := [f.name for f in schema if type(f.dataType) not in KINDS]:
            raise ValueError(f"no SQLite type for {bad}")
        os.makedirs(self.path, exist_ok=True)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        draft = f"{self.path}/{uuid.uuid4().hex}.draft"
        columns = ", ".join(f"{named(f.name)} {KINDS[type(f.dataType)]}{' PRIMARY KEY' if f.name == self.key else ''}" for f in self.schema)
        with closing(sqlite3.connect(draft)) as db:
            db.execute("PRAGMA journal_mode = OFF")  # a draft that isn't whole is never read
            db.execute("PRAGMA synchronous = OFF")
            db.execute(f"CREATE TABLE {named(self.table)} ({columns})")
            insert = f"INSERT INTO {named(self.table)} VALUES ({', '.join('?' * len(self.schema))})"
            for batch in batches:
                db.executemany(insert, zip(*(c.to_pylist() for c in batch.columns)))
            db.execute(f"PRAGMA user_version = {S.SCHEMA_VERSION}")
            db.commit()
        return Written(draft)

    def commit(self, messages: list) -> None:
        for m in messages:
            os.rename(m.draft, m.draft.removesuffix(".draft") + ".sqlite")

    def abort(self, messages: list) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.draft):
                os.remove(m.draft)


class SqliteFiles(D.DataSource):
    """Options: path, table; reading: splitBytes of a file a partition, maxVersion (user_version) that is understood; writing: key, the primary key."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_files"

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(schema, dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
        return Writer(schema, dict(self.options), overwrite)


def read(spark: SparkSession, path: str, table: str, schema: T.StructType | str, **options: object) -> DataFrame:
    """The rows of a table in all SQLite files of a folder, or of one file; the schema says which columns."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteFiles)
    return spark.read.format("sqlite_files").schema(schema).options(path=path, table=table, **options).load()


def write(df: DataFrame, path: str, table: str, key: str | None = None) -> None:
    """df as one SQLite file a partition, in a folder."""
    df.sparkSession.dataSource.register(SqliteFiles)
    options = {"path": path, "table": table} | ({"key": key} if key else {})
    df.write.format("sqlite_files").mode("append").options(**options).save()


def history(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The chat tables of SQLite histories, their ISO times as timestamps; a history that is newer than this code is refused."""
    told = {}
    for name, schema in (("projects", S.PROJECTS), ("conversations", S.CONVERSATIONS), ("messages", S.MESSAGES)):
        raw = T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.TimestampType) else f.dataType) for f in schema])
        rows = read(spark, path, name, raw, maxVersion=S.SCHEMA_VERSION)
        told[name] = rows.select(*(X.from_iso(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.TimestampType) else F.col(f.name) for f in schema))
    return told
