"""Synthetic streams with labelled anomalies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def anomalous(i: Column, every: int, duration: int) -> Column:
    """Whether step i is one of `duration` anomalous steps after each multiple of `every`, from the first one on."""
    return (i >= every) & (i % every <= duration - 1)


def iri(i: Column, name: str, changes_every: int | None = None) -> Column:
    """An IRI that is constant, or new after every `changes_every` steps."""
    part = F.lit(0) if changes_every is None else F.floor(i / changes_every)
    return F.concat(F.lit(f"http://example.org/{name}/"), F.substring(F.sha2(F.concat(F.lit(name), part.cast("string")), 256), 1, 20))


def bounded(low: float, high: float, seed: int) -> Column:
    """Normal values about the middle of [low, high], cut at its ends."""
    return F.greatest(F.lit(low), F.least(F.lit(high), (low + high) / 2 + F.randn(seed) * (high - low) / 6))


def shifted(low: float, high: float, multiplier: float, seed: int) -> Column:
    """Anomalous values beside [low, high]."""
    return F.when(F.rand(seed) < 0.5, high + multiplier * (high - low) * (0.5 + F.rand(seed + 1))).otherwise(low - multiplier * (high - low) * (0.5 + F.rand(seed + 2)))


def observations(spark: SparkSession, n: int, low: float = -10, high: float = 40, every: int = 80, duration: int = 5, multiplier: float = 1.0, seed: int = 1) -> DataFrame:
    """(graph_id, seq, ..., value, anomaly) of one synthetic stream of n steps, in the columns that `triplified` takes."""
    i = F.col("id")
    bad = anomalous(i, every, duration)
    return spark.range(n).select(
        F.lit("g-synthetic").alias("graph_id"), (i + 1).alias("seq"), i.alias("event_id"), F.timestamp_seconds(1767268800 + i * 864).alias("ts"), F.lit(1).cast("long").alias("user_id"), F.lit("synthetic").alias("event_type"),
        F.when(bad, shifted(low, high, multiplier, seed + 9)).otherwise(bounded(low, high, seed)).alias("value"), (i % 3).alias("k"), bad.alias("anomaly"),
    )
