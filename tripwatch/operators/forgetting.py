"""How often patterns count, when they become nominal and when they are forgotten, as a sweep over events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sequence import running
from .storage import materialise


def swept(observations: DataFrame, decay: int) -> DataFrame:
    """(graph_id, ap, t, phase, delta, freq) of observations(graph_id, t, ap), t from 1: +1 where a message has the pattern, -1 once it
    is decay messages old, and the sum so far; at a message the additions (phase 0) come first.

    What the first message has is never taken back, and several statements of a message that meet one pattern are taken back
    as one. With decay 0 or less nothing is forgotten.
    """
    seen = observations.select("graph_id", "ap", F.col("t").cast("long").alias("t"), F.lit(0).alias("phase"), F.lit(1).alias("delta"))
    if decay <= 0:
        return running(seen, ["graph_id", "ap"], ["t", "phase"], "delta").withColumn("freq", F.col("before") + F.col("delta")).drop("before")
    last = seen.groupBy("graph_id").agg(F.max("t").alias("end"))
    due = seen.where("t > 1").select("graph_id", "ap", "t").distinct().withColumn("t", F.col("t") + decay - 1).join(last, "graph_id").where("t <= end")
    events = seen.unionByName(due.select("graph_id", "ap", "t", F.lit(1).alias("phase"), F.lit(-1).alias("delta")))
    return running(events, ["graph_id", "ap"], ["t", "phase"], "delta").withColumn("freq", F.col("before") + F.col("delta")).drop("before")


def lifetimes(observations: DataFrame, decay: int, threshold: int) -> DataFrame:
    """(graph_id, ap, life, born, promoted, deleted, freq) of patterns in streams whose messages are all accepted.

    A pattern of the first message is nominal from then on; others are candidates until their frequency reaches the threshold.
    One whose frequency falls to 0 is deleted, and what comes later is a new one, the next life. freq is the last frequency. Sums
    are made range by range (see running), so a pattern of a third of all messages is no hot key.
    """
    events = materialise(swept(observations, decay).withColumn("gone", ((F.col("phase") == 1) & (F.col("freq") == 0)).cast("int")))
    told = running(events, ["graph_id", "ap"], ["t", "phase"], "gone", "life")
    reached = (F.col("phase") == 0) & (F.col("freq") >= threshold) if threshold > 0 else F.lit(False)
    lives = told.groupBy("graph_id", "ap", "life").agg(
        F.min(F.when(F.col("phase") == 0, F.col("t"))).alias("born"), F.min(F.when(reached, F.col("t"))).alias("reached"),
        F.max(F.when(F.col("gone") == 1, F.col("t"))).alias("deleted"), F.max(F.struct("t", "phase", "freq"))["freq"].alias("freq"),
    )
    promoted = F.when(F.col("born") == 1, F.lit(1).cast("long")).otherwise(F.col("reached"))
    return lives.select("graph_id", "ap", (F.col("life") + 1).alias("life"), "born", promoted.alias("promoted"), "deleted", "freq")
