"""Places in ordered streams and order statistics, without one task a stream.

Rows are dealt out in ranges of (stream, order), so that a stream of a third of all rows is cut into many ranges. A row's place is
its place in its range, and the rows of its stream in the ranges before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import materialise

_ROW_BITS = 33  # of monotonically_increasing_id: the rest is the number of the range
#: Quantiles of a selection's round, and values of a key that are sorted in one task.
CUTS, MOST = 256, 1 << 16


def ranged(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """rows in a table, sorted in ranges of keys and order: `_part` is the number of a row's range, `_at` grows by one within it."""
    cut = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_at", F.monotonically_increasing_id())
    return materialise(cut).withColumn("_part", F.shiftright("_at", _ROW_BITS))


def placed(rows: DataFrame, keys: list[str], order: list[str | Column], name: str = "place") -> DataFrame:
    """rows with their place, from 1, among those of equal keys in the order given; ties are in any order, as with row_number.

    One shuffle by range. What else moves is a count for each key and range.
    """
    columns = [F.col(o) if isinstance(o, str) else o for o in order]
    cut = ranged(rows, keys, columns)
    parts = cut.groupBy(*keys, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = materialise(parts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), (before - F.col("_first") + 1).alias("_off")))
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return cut.join(offsets, same).select(*rows.columns, (F.col("_at") + F.col("_off")).alias(name))


def running(rows: DataFrame, keys: list[str], order: list[str | Column], weight: str, name: str = "before") -> DataFrame:
    """rows with the sum of `weight` over the rows of equal keys that come before in the order given."""
    columns = [F.col(o) if isinstance(o, str) else o for o in order]
    cut = ranged(rows, keys, columns)
    inner = F.coalesce(F.sum(weight).over(W.partitionBy(*keys, "_part").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = cut.groupBy(*keys, "_part").agg(F.sum(weight).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = materialise(parts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), before.alias("_off")))
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return cut.withColumn("_in", inner).join(offsets, same).select(*rows.columns, (F.col("_in") + F.col("_off")).alias(name))


def order_statistics(samples: DataFrame, ranks: DataFrame, key: str = "graph_id", value: str = "value", most: int = MOST) -> DataFrame:
    """(key, rank, value) of ranks(key, rank), distinct ranks from 0, among the samples of each key; null and NaN values are left out.

    Each round cuts the interval that holds a rank by quantile sketches, counts what lies below and within the cut, and goes on
    with the part that has the rank, until an interval has `most` values or one value; these are sorted. Sketches and counts are
    merged in every task before they are shuffled, so that no stream is in one task.
    """
    rows = samples.where(F.col(value).isNotNull() & ~F.isnan(value)).select(F.col(key).alias("k"), F.col(value).cast("double").alias("v"))
    held = materialise(ranks.select(F.col(key).alias("k"), F.col("rank"), F.col("rank").alias("r"), F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi")))
    while True:
        parts = held.groupBy("k", "lo", "hi").agg(F.collect_list("r").alias("rs"))  # a key's intervals, few: ranks of one meet here
        # named anew, so that rows are summed up before a shuffle of their own and the join may split a large stream
        own = rows.join(parts, "k").where("v between lo and hi").select(F.struct("k").alias("key"), "lo", "hi", "v")
        sizes = own.groupBy("key", "lo", "hi").agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("top"), F.percentile_approx("v", [i / CUTS for i in range(CUTS + 1)], 20 * CUTS).alias("cuts")).select("key.k", "lo", "hi", "n", "least", "top", "cuts")
        at = held.join(sizes, ["k", "lo", "hi"]).withColumn("f", F.floor(F.col("r") * CUTS / F.col("n")).cast("int"))
        cut = lambda i: F.element_at("cuts", F.greatest(F.lit(1), F.least(F.lit(CUTS + 1), i)))
        big = (F.col("n") > most) & (F.col("least") < F.col("top"))
        at = materialise(at.select("k", "rank", "r", "lo", "hi", "n", big.alias("big"), F.when(big, cut(F.col("f"))).otherwise(F.col("least")).alias("a"), F.when(big, cut(F.col("f") + 3)).otherwise(F.col("top")).alias("b")))
        if at.where("big").isEmpty():
            break
        below = rows.join(at.where("big").select("k", "lo", "hi", "a", "b").distinct(), "k").where("v between lo and hi").groupBy(F.struct("k").alias("key"), "lo", "hi", "a", "b")
        below = below.agg(F.count_if(F.col("v") < F.col("a")).alias("under"), F.count_if(F.col("v") <= F.col("b")).alias("upto"), F.max(F.when(F.col("v") < F.col("a"), F.col("v"))).alias("last"), F.min(F.when(F.col("v") > F.col("b"), F.col("v"))).alias("next")).select("key.k", "lo", "hi", "a", "b", "under", "upto", "last", "next")
        cut_ = at.join(below, ["k", "lo", "hi", "a", "b"], "left")
        low, high = F.col("r") < F.col("under"), F.col("r") >= F.col("upto")
        new = lambda left, mid, right, old: F.when(~F.col("big"), old).when(low, left).when(high, right).otherwise(mid)
        held = materialise(cut_.select("k", "rank", new(F.col("r"), F.col("r") - F.col("under"), F.col("r") - F.col("upto"), F.col("r")).alias("r"), new(F.col("lo"), F.col("a"), F.col("next"), F.col("lo")).alias("lo"), new(F.col("last"), F.col("b"), F.col("hi"), F.col("hi")).alias("hi")))
    whole = at.where("a = b").select("k", "rank", F.col("a").alias("v"))
    few = at.where("a < b").groupBy("k", "lo", "hi").agg(F.collect_list(F.struct("rank", "r")).alias("asked"))
    sorted_ = rows.join(few, "k").where("v between lo and hi").groupBy("k", "lo", "hi", "asked").agg(F.array_sort(F.collect_list("v")).alias("vs"))
    got = sorted_.select("k", "vs", F.explode("asked").alias("x")).select("k", F.col("x.rank").alias("rank"), F.element_at("vs", (F.col("x.r") + 1).cast("int")).alias("v"))
    return whole.unionByName(got).select(F.col("k").alias(key), "rank", F.col("v").alias(value))
