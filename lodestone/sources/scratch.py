"""Tables written to the folder all executors share: what is in one is never computed again."""

from __future__ import annotations

import getpass
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from lodestone.sources.objects import delete


def scratch_root(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; one of our own only where it is unset and all run on one machine."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that all executors share")
    return (named or f"file://{tempfile.gettempdir()}/lodestone-{getpass.getuser()}").rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, *partitions: str) -> tuple[DataFrame, str]:
    """``df`` as written to a new folder, and the folder; with ``partitions``, in a subfolder for each of their values."""
    path = fresh(df.sparkSession, name)
    df.write.partitionBy(*partitions).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        delete(spark, path)
