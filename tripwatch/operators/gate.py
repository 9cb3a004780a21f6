"""Prediction intervals that keep learning: each value is judged by the accepted values before it in its stream.

What is accepted depends on what was accepted before, so the whole is a fixpoint. Streams are cut into blocks of messages. A pass
judges all blocks at once, each from the values that the pass before accepted ahead of it; within a block the order is kept
exactly. The first block of a stream is right after one pass, and every pass makes one more right at least; as a block depends on
few ranks of what is ahead, passes are few. They end when no block's past has changed.

A block needs only those past values whose ranks an interval's ends can reach within it. They are found with counts of the accepted
values by block and by bucket of value rank: sums over the blocks ahead, then over the buckets, give the rank at which each
bucket begins for each block. How far ranks can move within a block is bounded by the block's own values below a bucket, and
for the upper ends, which are counted from the top, by those above it. So a block gets few buckets, about as many values
as its own, and is judged in one task. Blocks that are right are not read again but for their accepted values, and not rewritten.
"""

from __future__ import annotations

from bisect import bisect_left
from functools import reduce
from math import ceil, floor

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.terms import CRITICAL, NOMINAL, SUSPICIOUS
from .sequence import placed
from .statistics import LEAST_FOR_INTERVAL, interval_ranks
from .storage import materialise

#: Messages of a block at least; longer streams have blocks of the square root of their length.
BLOCK = 1 << 16
#: Buckets of value rank to a block's length.
FINER = 4
_ROW = "graph_id string, block long, size long, seq long, name long, value double, bucket long, fine boolean, ok boolean"
_JUDGED = _ROW + ", n long, code int, lo double, hi double, changed boolean"
#: Passes whose settled blocks stay in tables of their own before these are put together.
TABLES = 8


class Ranked:
    """Accepted values by rank, where ranks are needed: runs of neighbours, each from a known rank on."""

    def __init__(self, ranks: np.ndarray, names: np.ndarray, values: np.ndarray, n: int):
        """ranks: of the values ahead of the block that are known, ascending; names: their order in the stream's values."""
        self.n = n
        cut = [0, *(np.flatnonzero(np.diff(ranks) != 1) + 1).tolist(), len(ranks)]
        self.runs = [[int(ranks[a]), names[a:b].tolist(), values[a:b].tolist()] for a, b in zip(cut, cut[1:], strict=False) if a < b] or [[0, [], []]]

    def at(self, rank: float) -> float:
        """The value at a rank, in line between two."""
        low, high = self._value(floor(rank)), self._value(ceil(rank))
        return low + (high - low) * (rank - floor(rank))

    def _value(self, rank: int) -> float:
        for first, _, values in self.runs:
            if first <= rank < first + len(values):
                return values[rank - first]
        raise LookupError(f"rank {rank} of {self.n}")

    def add(self, name: int, value: float) -> None:
        for run in self.runs:
            first, names, values = run
            if names and name < names[0] and first:
                run[0] += 1
            elif not names or name < names[-1] or first + len(names) == self.n:
                i = bisect_left(names, name)
                names.insert(i, name)
                values.insert(i, value)
        self.n += 1


def judged_block(rows: pd.DataFrame, levels: list[tuple[float, int]], tolerance: float) -> pd.DataFrame:
    """The messages of a block with n, the accepted values before each, and its code and interval; rows holds them and the past values."""
    past, own = rows[rows.kind == 0].sort_values("name"), rows[rows.kind == 1].sort_values("seq")
    within = past.groupby("bucket").cumcount().to_numpy() if len(past) else np.empty(0, np.int64)
    known = Ranked(past.low.to_numpy() + within, past.name.to_numpy(), past.value.to_numpy(), int(own.low.iloc[0]) if len(own) else 0)
    out = []
    for seq, name, value, ok, fine in zip(own.seq, own.name, own.value, own.ok, own.fine, strict=True):
        n, code, lo, hi = known.n, NOMINAL, None, None
        if n >= LEAST_FOR_INTERVAL:
            ends = []
            for p, violation in levels:
                low = max(0.0, (n + 1 - (n + 1) * p) / 2 - 1)
                a, b = known.at(low), known.at(min(n - low - 1, n - 1))
                by = abs(b - a) * tolerance
                ends.append((a - by, b + by))
                if value <= a - by or value > b + by:
                    code = violation
                    break
            lo, hi = ends[-1] if code else ends[0]
        learnt = code == NOMINAL and fine
        if learnt:
            known.add(name, value)
        out.append((seq, learnt, n, code, lo, hi, learnt != ok))
    return pd.DataFrame(out, columns=["seq", "learnt", "n", "code", "lo", "hi", "changed"])


def interval_codes(samples: DataFrame, settings: Settings = Settings(), block: int = BLOCK) -> DataFrame:
    """(graph_id, seq, value, n, code, lo, hi) of samples(graph_id, seq, value): n accepted values were before, [lo, hi] is the widened
    interval that decided (null for the first hundred accepted), code tells whether the value is out of it. Only values
    with code 0 are learnt. Null values are left out. samples may have a boolean column `fine`: where it is false, the value's
    message is rejected for another reason, and the value isn't learnt either.
    """
    levels = [(1 - settings.alpha_critical, CRITICAL), (1 - settings.alpha_suspicious, SUSPICIOUS)]
    fine = F.coalesce("fine", F.lit(False)) if "fine" in samples.columns else F.lit(True)
    own = samples.where("value is not null").select("graph_id", F.col("seq").cast("long").alias("seq"), F.col("value").cast("double").alias("value"), fine.alias("fine"))
    named = placed(own, ["graph_id"], ["value", "seq"], "name")
    sizes = named.groupBy("graph_id").agg(F.greatest(F.lit(block), F.ceil(F.sqrt(F.max("seq")))).cast("long").alias("size"))
    fresh = named.join(sizes, "graph_id").withColumn("block", F.expr("(seq - 1) div size")).withColumn("bucket", F.expr(f"(name - 1) div greatest(size div {FINER}, 1)"))
    rows = materialise(fresh.withColumn("ok", F.col("fine")).select(*_columns(_ROW)))
    tables: list[DataFrame] = []  # of settled blocks
    while True:
        judged = materialise(_passed(rows, tables, levels, settings.pi_tolerance))
        # a block is settled if no change is ahead of it: no later pass judges a block ahead of it either
        changed = materialise(judged.where("changed").groupBy("graph_id").agg(F.min("block").alias("first")))
        told = judged.drop("changed").join(changed, "graph_id", "left")
        tables.append(told.where("first is null or block <= first").drop("first"))
        if changed.isEmpty():
            return _together(tables).select("graph_id", "seq", "value", "n", "code", "lo", "hi")
        if len(tables) > TABLES:
            tables = [materialise(_together(tables))]
        rows = told.where("block > first").select(*_columns(_ROW))


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _together(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def _passed(rows: DataFrame, tables: list[DataFrame], levels: list[tuple[float, int]], tolerance: float) -> DataFrame:
    """rows, the blocks that are due, judged by what the pass before accepted in them and by the settled blocks of tables."""
    every = _together([rows.withColumn("due", F.lit(True)), *[t.select(*_columns(_ROW), F.lit(False).alias("due")) for t in tables]])
    counts = materialise(every.groupBy("graph_id", "size", "block", "due", "bucket").agg(F.count_if("ok").alias("c"), F.count("*").alias("own")))
    per_block = counts.groupBy("graph_id", "block", "size", "due").agg(F.sum("c").alias("c"))
    ahead = F.coalesce(F.sum("c").over(W.partitionBy("graph_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = materialise(per_block.withColumn("n0", ahead))
    # square roots of a stream: its buckets by its blocks are no more than its messages; a stream of one block has no past
    large = blocks.groupBy("graph_id").agg(F.max("block").alias("most")).where("most > 0").select("graph_id")
    grid = counts.join(large, "graph_id").select("graph_id", "bucket").distinct().join(blocks.select("graph_id", "block", "size", "n0", "due"), "graph_id").join(counts.select("graph_id", "bucket", "block", "c", "own"), ["graph_id", "bucket", "block"], "left")
    upto = F.coalesce(F.sum("c").over(W.partitionBy("graph_id", "bucket").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    by_bucket = W.partitionBy("graph_id", "block").orderBy("bucket")
    known = grid.withColumn("had", upto).where("due").withColumn("low", F.coalesce(F.sum("had").over(by_bucket.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    known = known.withColumn("own", F.coalesce("own", F.lit(0))).withColumn("within", F.sum("own").over(by_bucket.rowsBetween(W.unboundedPreceding, 0))).where("had > 0")
    # the block's own values before the next bucket with a past, and after the one before
    known = known.withColumn("below", F.coalesce(F.lead(F.col("within") - F.col("own")).over(by_bucket), F.col("size"))).withColumn("above", F.col("size") - F.coalesce(F.lag("within").over(by_bucket), F.lit(0)))
    reach, top = F.lit(False), F.col("n0") - F.col("low") - F.col("had")
    for p, _ in levels:
        begin, end = F.floor(interval_ranks(F.col("n0"), p)[0]), F.ceil(interval_ranks(F.col("n0") + F.col("size"), p)[0])
        reach = reach | ((F.col("low") + F.col("had") + F.col("below") > begin) & (F.col("low") <= end)) | ((top + F.col("had") + F.col("above") > begin) & (top <= end))
    need = known.where(reach).select("graph_id", "bucket", F.col("block").alias("for_block"), F.col("size").alias("for_size"), "low")
    none = F.lit(0).cast("long")
    past = every.where("ok").join(F.broadcast(need), ["graph_id", "bucket"]).where("block < for_block")
    past = past.select("graph_id", F.col("for_block").alias("block"), none.alias("size"), F.lit(0).alias("kind"), none.alias("seq"), "name", "value", "bucket", "low", F.lit(True).alias("ok"), F.lit(True).alias("fine"))
    mine = rows.join(blocks.select("graph_id", "block", "n0"), ["graph_id", "block"]).select("graph_id", "block", "size", F.lit(1).alias("kind"), "seq", "name", "value", "bucket", F.col("n0").alias("low"), "ok", "fine")

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf.kind == 1].sort_values("seq").reset_index(drop=True)
        found = judged_block(pdf, levels, tolerance)
        return own.assign(ok=found.learnt, **{c: found[c] for c in ("n", "code", "lo", "hi", "changed")})[_columns(_JUDGED)]

    return past.unionByName(mine).groupBy("graph_id", "block").applyInPandas(judge, _JUDGED)
