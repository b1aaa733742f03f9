"""Tables that cut the lineage of iterative jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``, which all executors share.

    A session that names no such folder gets a temporary one if it runs in one process, as tests do, and an error if not.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="seqloom-"))
    return f"{sc.getCheckpointDir()}/{kind}-{uuid.uuid4()}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as a table to the shared folder, and read again."""
    path = shared_folder(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
