"""A table of states: rows of a key and a version that grows, each with what it holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _rank(key: str, version: str) -> Column:
    return F.row_number().over(W.partitionBy(key).orderBy(F.desc(version)))


def latest(states: DataFrame, key: str = "graph_id", version: str = "version") -> DataFrame:
    """The row of the greatest version of each key. Maxima are summed up before the shuffle, so no key is hot."""
    rest = [c for c in states.columns if c not in (key, version)]
    top = states.groupBy(key).agg(F.max(F.struct(version, *rest)).alias("top"))
    return top.select(key, "top.*").select(*states.columns)


def added(states: DataFrame, more: DataFrame) -> DataFrame:
    """states with the rows of more; versions must be new."""
    return states.unionByName(more)


def removed(states: DataFrame, keys: DataFrame, key: str = "graph_id") -> DataFrame:
    """states without any version of keys."""
    return states.join(keys.select(key).distinct(), key, "left_anti").select(*states.columns)


def prunable(states: DataFrame, keep: int = 1, key: str = "graph_id", version: str = "version") -> DataFrame:
    """The rows that aren't among the `keep` latest versions of their key."""
    return states.withColumn("rank", _rank(key, version)).where(F.col("rank") > keep).drop("rank")


def pruned(states: DataFrame, keep: int = 1, key: str = "graph_id", version: str = "version") -> DataFrame:
    """The `keep` latest versions of each key."""
    return states.withColumn("rank", _rank(key, version)).where(F.col("rank") <= keep).drop("rank")


def size(states: DataFrame, key: str = "graph_id") -> DataFrame:
    """(keys, versions): how many a table of states holds."""
    return states.agg(F.countDistinct(key).alias("keys"), F.count("*").alias("versions"))
