"""Tables in the shared folder, which cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; in local mode a temporary one where it is unset."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    top = top or tempfile.mkdtemp(prefix="tripwatch-")
    return f"{top.rstrip('/')}/tripwatch-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """df written as Parquet and read again: it is computed once and has no lineage to lose."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
