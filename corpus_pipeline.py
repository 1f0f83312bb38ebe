"""The corpus pipeline: documents through five stages, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from turnlake.llm.common import shared_folder
from turnlake.llm.stages import STAGES

__all__ = ["ORACLE_SQL", "STAGES", "run"]

#: Language identification is learned, so no SQL gives run()'s rows; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Stages are kept in the folder that the session names for checkpoints,

    and each is removed when the next one is written; the last one stays, since it is the result.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(out := f"{folder}/{k}-{name}")
        docs = spark.read.parquet(out)
        if k:
            before = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
            before.getFileSystem(spark._jsc.hadoopConfiguration()).delete(before, True)
    return docs
