"""Connected components of an edge table, as a Spark job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _stars(parents: DataFrame) -> DataFrame:
    """(node, root) of parents(node, root), where each root is a node and no greater than its own: pointers are doubled until they end."""
    while True:
        far = materialise(parents.join(parents.select(F.col("node").alias("root"), F.col("root").alias("far")), "root").select("node", F.col("far").alias("root"), F.col("root").alias("old")))
        parents = far.select("node", "root")
        if not far.where("root <> old").limit(1).count():
            return parents


def contracted(near: DataFrame, roots: DataFrame) -> DataFrame:
    """The edges near(node, next) between different roots(node, root), named by them, each once."""
    far = near.join(roots.select(F.col("node").alias("next"), F.col("root").alias("far")), "next").join(roots, "node")
    return far.where("root <> far").select(F.col("root").alias("node"), F.col("far").alias("next")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node that it reaches. Nulls and loops are dropped.

    Every round each node points to the least of itself and its neighbours, and pointers are followed to their ends (pointer
    jumping); then the parts found become the nodes, and only edges between them are left. A round leaves half of the nodes
    at most, so the rows of all rounds together are in proportion to the edges. Minima are summed up before each shuffle,
    so a hub is no hot key there. Rounds are written to the shared folder.
    """
    near = edges.where(f"{a} is not null and {b} is not null and {a} <> {b}").select(F.explode(F.array(F.struct(F.col(a).alias("node"), F.col(b).alias("next")), F.struct(F.col(b).alias("node"), F.col(a).alias("next")))).alias("e")).select("e.*").distinct()
    near, labels = materialise(near), None
    while True:
        roots = _stars(materialise(near.groupBy("node").agg(F.least(F.min("next"), F.first("node")).alias("root"))))
        if labels is None:
            labels = roots
        else:
            up = roots.select(F.col("node").alias("root"), F.col("root").alias("up"))
            labels = materialise(labels.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root")))
        near = materialise(contracted(near, roots))
        if near.isEmpty():
            return labels
