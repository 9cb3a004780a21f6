"""Batch replay of streams through the gated fold, and the reports that it gives."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.literals import numeric
from ..operators.fold import step
from ..operators.matching import anchored

#: Partitions of the fold at least: graphs are few and large, or many and small.
PARTS = 96
FINDINGS = "graph_id string, seq long, g_t long, code int, ap_id string, stmt_ix int, label string, finding int, message string"
PATTERNS = "graph_id string, g_t long, ap_id string, anchor string, relation string, status string, ap_t long, freq long, dtype string, samples long"


def messages(statements: DataFrame) -> DataFrame:
    """(graph_id, seq, rows): each message as one row, an array of its enriched statements in their order."""
    rich = anchored(statements).withColumn("num", F.when(F.col("o_kind") == "literal", numeric(F.col("o_value"), F.col("dtype_eff"))))
    row = F.struct("stmt_ix", "anchor", F.col("p").alias("relation"), "o_kind", "o_value", "dtype_eff", "o_lang", "num", "s")
    return rich.groupBy("graph_id", "seq").agg(F.array_sort(F.collect_list(row)).alias("rows"))


def _rows(own) -> list[tuple]:
    clean = lambda x: None if x is None or x != x else x
    return [tuple(clean(v) for v in (r.values() if isinstance(r, dict) else r)) for r in own]


def _in_order(statements: DataFrame) -> DataFrame:
    """messages(statements), each graph's in one partition and in order, so that a task can stream them past one state.

    The number of partitions is given, as Spark would join small ones and fold their graphs one after another.
    """
    session = statements.sparkSession
    n = max(PARTS, int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism)
    return messages(statements).repartition(n, "graph_id").sortWithinPartitions("graph_id", "seq")


def replayed(statements: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Findings of each message; one row with a null label for a message without any, none for a graph's first.

    A graph's messages depend on one another, so they are folded in order in one task; graphs are dealt out by their ids.
    A task holds a batch of messages and the state of the graph that it is at, never a whole stream.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, graph, fits = None, None, {}
        for pdf in batches:
            out = []
            for m in pdf.itertuples():
                if m.graph_id != graph:
                    state, graph, fits = None, m.graph_id, {}
                state, found, code = step(state, graph, int(m.seq), _rows(m.rows), settings, fits)
                if code is not None:
                    out += [(graph, m.seq, state["t"], code, *f) for f in found or [(None,) * 5]]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FINDINGS.split(", ")]).astype({"stmt_ix": "Int32", "finding": "Int32"})

    return _in_order(statements).mapInPandas(run, FINDINGS)


def learnt(statements: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The assertion patterns of each graph after its last message."""

    def patterns(graph: str | None, state: dict | None) -> pd.DataFrame:
        rows = [(graph, state["t"], a["id"], a["anchor"], a["relation"], a["status"], a["t"], a["freq"], a["dtype"], a["dist"]["n"] if a["dist"] else 0) for a in (state or {"aps": []})["aps"]]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in PATTERNS.split(", ")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, graph, fits = None, None, {}
        for pdf in batches:
            for m in pdf.itertuples():
                if m.graph_id != graph:
                    yield patterns(graph, state)
                    state, graph, fits = None, m.graph_id, {}
                state, _, _ = step(state, graph, int(m.seq), _rows(m.rows), settings, fits)
        yield patterns(graph, state)

    return _in_order(statements).mapInPandas(run, PATTERNS)


def reports(findings: DataFrame, level: int = 3) -> DataFrame:
    """(graph_id, seq, code, n) of the messages whose code is at least `level`."""
    return findings.where(F.col("code") >= level).groupBy("graph_id", "seq").agg(F.max("code").alias("code"), F.count("label").alias("n"))


def dumped(state: dict) -> str:
    """A state as JSON; multisets as lists of pairs, which keep their order and the kinds of their values."""
    aps = [a | {"dist": a["dist"] and a["dist"] | {"counts": list(a["dist"]["counts"].items())}} for a in state["aps"]]
    return json.dumps(state | {"aps": aps})


def loaded(text: str) -> dict:
    state = json.loads(text)
    for a in state["aps"]:
        if a["dist"]:
            a["dist"]["counts"] = {v: n for v, n in a["dist"]["counts"]}
    return state
