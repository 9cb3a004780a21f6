"""Statistics of samples: multisets, windows by count, prediction intervals, proportions and the bootstrap test."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .sequence import order_statistics, placed, running
from .storage import materialise

LEAST_FOR_INTERVAL = 100
#: Buckets of rank in which a draw looks for its value.
RANK_BUCKETS = 1024


def multiset(samples: DataFrame, key: str = "graph_id", value: str = "value") -> DataFrame:
    """(key, value, n, first_ix) of samples(key, seq, value): equal values share the place of the first."""
    return samples.groupBy(key, value).agg(F.count("*").alias("n"), F.min("seq").alias("first_ix"))


def places(samples: DataFrame, key: str = "graph_id", value: str = "value") -> DataFrame:
    """samples(key, seq, value) with place_from_end: 1 for the last in the order of first-seen values, repeats beside each other."""
    first = samples.groupBy(key, value).agg(F.min("seq").alias("first_ix"))
    seen = samples.join(first, [key, value])
    return placed(seen, [key], [F.desc("first_ix"), F.desc("seq")], "place_from_end")


def band(place: Column, samplesize: int, samplegap: int) -> Column:
    """sample, gap or population by the place from the end."""
    return F.when(place <= samplesize, "sample").when(place <= samplesize + samplegap, "gap").otherwise("population")


def fluidity(samples: DataFrame, key: str = "graph_id", value: str = "value") -> DataFrame:
    """(key, n, n_distinct, fluidity): distinct over all, 0 for a single value."""
    per = samples.groupBy(key, value).agg(F.count("*").alias("c"))
    out = per.groupBy(key).agg(F.sum("c").alias("n"), F.count("*").alias("n_distinct"))
    return out.withColumn("fluidity", F.when(F.col("n_distinct") <= 1, 0.0).otherwise(F.col("n_distinct") / F.col("n")))


def interval_ranks(n: Column, level: float | Column) -> tuple[Column, Column]:
    """The fractional ranks, from 0, of the ends of a prediction interval of n samples."""
    level = F.lit(level) if isinstance(level, float) else level
    low = F.greatest(F.lit(0.0), (n + 1 - (n + 1) * level) / 2 - 1)
    return low, F.least(n - low - 1, n - 1.0)


def intervals(samples: DataFrame, levels: list[float], key: str = "graph_id", value: str = "value") -> DataFrame:
    """(key, level, n, lo, hi): non-parametric prediction intervals from order statistics, for keys with 100 samples or more.

    The order statistics come from a distributed selection (see sequence.order_statistics).
    """
    n = samples.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(key).agg(F.count("*").alias("n")).where(f"n >= {LEAST_FOR_INTERVAL}")
    low, high = interval_ranks(F.col("n"), F.col("level"))
    asked = materialise(n.withColumn("level", F.explode(F.array(*[F.lit(float(p)) for p in levels]))).withColumn("rl", low).withColumn("ru", high))
    at = F.explode(F.array(F.floor("rl"), F.ceil("rl"), F.floor("ru"), F.ceil("ru")))
    values = order_statistics(samples, asked.select(key, at.alias("rank")).distinct(), key, value)
    held = values.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("rank", value))).alias("at"))  # four values a level
    line = lambda r: F.col("at")[F.floor(r)] + (F.col("at")[F.ceil(r)] - F.col("at")[F.floor(r)]) * (F.col(r) - F.floor(r))
    return asked.join(held, key).select(key, "level", "n", line("rl").alias("lo"), line("ru").alias("hi"))


def widened(bounds: DataFrame, tolerance: float) -> DataFrame:
    """bounds with both ends moved out by tolerance times the width."""
    by = F.abs(F.col("hi") - F.col("lo")) * tolerance
    return bounds.withColumns({"lo": F.col("lo") - by, "hi": F.col("hi") + by})


def proportions(samples: DataFrame, key: str = "graph_id", value: str = "value") -> DataFrame:
    per = samples.groupBy(key, value).agg(F.count("*").alias("n"))
    total = per.groupBy(key).agg(F.sum("n").alias("total"))
    return per.join(total, key).select(key, value, (F.col("n") / F.col("total")).alias("share"))


def proportion_grid(a: DataFrame, b: DataFrame, key: str = "graph_id", value: str = "value") -> DataFrame:
    """(key, value, share_a, share_b) over the values of both sides; a side that lacks a value has null for it, not zero."""
    side = lambda x, n: proportions(x, key, value).withColumnRenamed("share", n)
    return side(a, "share_a").join(side(b, "share_b"), [key, value], "full")


def hashed(*parts: Column) -> Column:
    """60 bits of the MD5 of the parts: a number that depends on nothing but them, for draws that are the same everywhere."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 15), 16, 10).cast("long")


def drawn(side: DataFrame, plan: DataFrame, name: str, seed: int = 0, key: str = "graph_id", value: str = "value") -> DataFrame:
    """(key, r, value): draws with replacement from side(key, value), as many resamples and draws of each as plan(key, resamples,
    draws) says.

    Draw i of resample r takes the sample whose rank by value is hashed(seed, key, name, r, i) mod n. Equal values are
    counted, and a draw finds its value by the counts before it: populations aren't expanded.
    """
    counted = running(side.groupBy(key, value).agg(F.count("*").alias("c")), [key], [value], "c")
    sizes = materialise(counted.groupBy(key).agg(F.sum("c").alias("n")).join(plan, key).withColumn("width", F.expr(f"greatest(n div {RANK_BUCKETS}, 1L)")))
    spans = counted.join(sizes.select(key, "width"), key).select(key, value, "before", "c", F.explode(F.expr("sequence(before div width, (before + c - 1) div width)")).alias("bucket"))
    rank = hashed(F.lit(seed), F.col(key), F.lit(name), F.col("r"), F.col("i")) % F.col("n")
    picks = sizes.select(key, "n", "width", "draws", F.explode(F.expr("sequence(0L, resamples - 1)")).alias("r")).select("*", F.explode(F.expr("sequence(0L, draws - 1)")).alias("i")).withColumn("ix", rank)
    return picks.withColumn("bucket", F.expr("ix div width")).join(spans, [key, "bucket"]).where("ix >= before and ix < before + c").select(key, "r", value)


#: The statistics of a continuous fit test, by name; a caller may give others.
STATISTICS: dict[str, Callable[[str], Column]] = {"mean": F.avg, "sd": F.stddev_samp, "median": F.median}


def resampled(draws: DataFrame, key: str = "graph_id", value: str = "value", statistics: dict[str, Callable[[str], Column]] = STATISTICS) -> DataFrame:
    """(key, r, a column for each statistic) of draws(key, r, value), rounded so that equal statistics are equal however they were
    summed."""
    return draws.groupBy(key, "r").agg(*[F.round(f(value), 9).alias(name) for name, f in statistics.items()])


def _plan(sample: DataFrame, resamples: int, share: float, key: str) -> DataFrame:
    """Each key draws a share of its own sample's size."""
    return sample.groupBy(key).agg(F.greatest(F.floor(F.count("*") * F.lit(share)), F.lit(1)).alias("draws")).withColumn("resamples", F.lit(resamples).cast("long"))


def bootstrap(sample: DataFrame, population: DataFrame, resamples: int = 1000, share: float = 0.67, seed: int = 0, key: str = "graph_id", statistics: dict[str, Callable[[str], Column]] = STATISTICS) -> DataFrame:
    """(key, p_ and a statistic's name for each): how often a resample of the population has less than one of the sample."""
    plan = _plan(sample, resamples, share, key)
    a, b = (resampled(drawn(side, plan, name, seed, key), key, statistics=statistics) for side, name in ((population, "a"), (sample, "b")))
    b = b.select(key, "r", *[F.col(c).alias(f"b_{c}") for c in statistics])
    return a.join(b, [key, "r"]).groupBy(key).agg(*[F.avg(F.when(F.col(c) < F.col(f"b_{c}"), 1.0).otherwise(0.0)).alias(f"p_{c}") for c in statistics])


def bootstrap_discrete(sample: DataFrame, population: DataFrame, resamples: int = 1000, share: float = 0.67, seed: int = 0, key: str = "graph_id", value: str = "value") -> DataFrame:
    """(key, value, n_valid, p) for each value of either side: how often its share in a resample of the population is under that in
    one of the sample, among the n_valid resamples in which both have it; p is null where there is none."""
    plan = _plan(sample, resamples, share, key)
    a, b = (drawn(side, plan, name, seed, key, value).groupBy(key, "r", value).agg(F.count("*").alias(f"n_{name}")) for side, name in ((population, "a"), (sample, "b")))
    both = a.join(b, [key, "r", value]).groupBy(key, value).agg(F.count("*").alias("n_valid"), F.count_if(F.col("n_a") < F.col("n_b")).alias("less"))
    support = population.select(key, value).union(sample.select(key, value)).distinct()
    return support.join(both, [key, value], "left").select(key, value, F.coalesce("n_valid", F.lit(0)).alias("n_valid"), (F.col("less") / F.col("n_valid")).alias("p"))


def any_rejected(p: DataFrame, alpha: float, key: str = "graph_id") -> DataFrame:
    """(key, rejected) of p(key, p): whether any value's p is beyond alpha / 2 from an end; nulls reject nothing."""
    beyond = (F.col("p") < alpha / 2) | (F.col("p") > 1 - alpha / 2)
    return p.groupBy(key).agg(F.coalesce(F.bool_or(beyond), F.lit(False)).alias("rejected"))


def rejected(alpha: float, *p: Column, every: bool = True) -> Column:
    """Vote: more than half of the statistics reject (every), or any does."""
    votes = [F.when((x < alpha / 2) | (x > 1 - alpha / 2), 1).otherwise(0) for x in p]
    total = votes[0]
    for v in votes[1:]:
        total = total + v
    return total * 2 > len(p) if every else total > 0
