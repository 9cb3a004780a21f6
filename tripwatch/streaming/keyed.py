"""The gated fold with typed state: a map of assertion patterns for each graph, which a table can fill and a table can show.

    detected(messages, initial=patterns_table)

needs the RocksDB state store. A micro-batch writes only the patterns that it has changed. After a restart from nothing but a table
of patterns (see `states`), findings are those that the old query would have given.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..config import Settings
from ..operators.fold import step
from ..plans.replay import FINDINGS, _in_order, _rows

_VALUE = "struct<text: string, num: double, n: bigint>"
#: A pattern: place keeps the order in which a graph's patterns came; samples are in first-seen order, recent in order of arrival.
PATTERN = (
    f"place int, anchor string, relation string, status string, t bigint, freq bigint, kind string, value string, dtype string, lang string, num double, born bigint, "
    f"continuous boolean, dist_t bigint, samples array<{_VALUE}>, recent array<{_VALUE}>"
)
#: A graph's state as a table: a row for each pattern, with the graph's epoch and the epochs at which the pattern's frequency falls.
STATES = f"graph_id string, g_t bigint, ap_id string, due array<bigint>, {PATTERN}"
_FIELDS = [c.strip().split(" ")[0] for c in ("place, anchor, relation, status, t, freq, kind, value, dtype, lang, num, born, continuous, dist_t, samples, recent").split(",")]


def _sample(value: float | str, n: int) -> tuple:
    return (value, None, n) if isinstance(value, str) else (None, value, n)


def _value(row) -> float | str:
    text, num = (row["text"], row["num"]) if isinstance(row, dict) else (row[0], row[1])
    return text if text is not None else float(num)


def pattern_row(ap: dict, place: int) -> tuple:
    """A pattern of the fold in the columns of PATTERN."""
    dist = ap["dist"]
    head = (place, ap["anchor"], ap["relation"], ap["status"], ap["t"], ap["freq"], ap["kind"], ap["value"], ap["dtype"], ap["lang"], ap["num"], ap["born"])
    if dist is None:
        return (*head, None, None, None, None)
    return (*head, ap["continuous"], dist["t"], [_sample(v, n) for v, n in dist["counts"].items()], [_sample(v, 1) for v in dist["order"]])


def pattern_of(ap_id: str, row: dict) -> dict:
    """The pattern that pattern_row gave."""
    clean = lambda x: None if x is None or (isinstance(x, float) and x != x) else x
    ap = {"id": ap_id} | {k: clean(row[k]) for k in ("anchor", "relation", "status", "kind", "value", "dtype", "lang", "num")} | {k: int(row[k]) for k in ("t", "freq", "born")} | {"dist": None}
    if clean(row["dist_t"]) is not None:
        counts = {_value(x): int(x["n"] if isinstance(x, dict) else x[2]) for x in row["samples"]}
        numbers = sorted(v for v, n in counts.items() for _ in range(n) if not isinstance(v, str))
        ap |= {"continuous": bool(row["continuous"]), "dist": {"counts": counts, "n": sum(counts.values()), "t": int(row["dist_t"]), "order": [_value(x) for x in row["recent"]], "sorted": numbers}}
    return ap


class Detector(StatefulProcessor):
    def __init__(self, settings: Settings):
        self.settings = settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.graph = handle.getValueState("graph", "t bigint")
        self.patterns = handle.getMapState("patterns", "ap_id string", PATTERN)
        self.due = handle.getMapState("due", "t bigint", "ap_ids array<string>")

    def _load(self) -> tuple[dict | None, dict[str, tuple]]:
        """The fold's state of the key, and its patterns as they are stored."""
        if not self.graph.exists():
            return None, {}
        stored = {k[0]: tuple(v) for k, v in self.patterns.iterator()}
        aps = [pattern_of(i, dict(zip(_FIELDS, row, strict=True))) for i, row in sorted(stored.items(), key=lambda x: x[1][0])]
        due = {str(k[0]): list(v[0]) for k, v in self.due.iterator()}
        return {"t": int(self.graph.get()[0]), "aps": aps, "due": due}, stored

    def _store(self, state: dict, stored: dict[str, tuple], due: set[str]) -> None:
        self.graph.update((state["t"],))
        place = max((r[0] for r in stored.values()), default=-1)
        for ap in state["aps"]:
            old = stored.get(ap["id"])
            if old is None:
                place += 1
            new = pattern_row(ap, place if old is None else old[0])
            if old is None or _plain(old) != _plain(new):
                self.patterns.updateValue((ap["id"],), new)
        for gone in stored.keys() - {ap["id"] for ap in state["aps"]}:
            self.patterns.removeKey((gone,))
        for t in due - state["due"].keys():
            self.due.removeKey((int(t),))
        for t, ids in state["due"].items():
            self.due.updateValue((int(t),), (ids,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, stored = self._load()
        due, out, fits = set(state["due"]) if state else set(), [], {}
        for m in pd.concat(list(rows)).sort_values("seq", kind="stable").itertuples():
            state, found, code = step(state, key[0], int(m.seq), _rows(m.rows), self.settings, fits)
            if code is not None:
                out += [(key[0], m.seq, state["t"], code, *f) for f in found or [(None,) * 5]]
        self._store(state, stored, due)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in FINDINGS.split(", ")]).astype({"stmt_ix": "Int32", "finding": "Int32"})

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        due: dict[int, list[str]] = {}
        for row in initialState.to_dict("records"):
            self.graph.update((int(row["g_t"]),))
            ap = pattern_of(row["ap_id"], row)
            self.patterns.updateValue((row["ap_id"],), pattern_row(ap, int(row["place"])))
            for t in row["due"]:
                due.setdefault(int(t), []).append(row["ap_id"])
        for t, ids in due.items():
            self.due.updateValue((t,), (sorted(ids),))

    def close(self) -> None:
        pass


def _plain(row: tuple) -> list:
    """A stored row in lists and tuples, to compare."""
    return [[tuple(y) for y in x] if isinstance(x, (list, tuple)) or hasattr(x, "tolist") else x for x in row]


def detected(messages: DataFrame, settings: Settings = Settings(), initial: DataFrame | None = None) -> DataFrame:
    """Findings of a stream of messages(graph_id, seq, rows), see `plans.replay.messages`; initial: a table of states to go on from."""
    return messages.groupBy("graph_id").transformWithStateInPandas(Detector(settings), FINDINGS, "append", "none", initial.groupBy("graph_id") if initial is not None else None)


def states(statements: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The state of each graph after its last message, in the columns of STATES."""

    def rows(graph: str | None, state: dict | None) -> pd.DataFrame:
        out = []
        for i, ap in enumerate((state or {"aps": []})["aps"]):
            out.append((graph, state["t"], ap["id"], [int(t) for t, ids in state["due"].items() if ap["id"] in ids], *pattern_row(ap, i)))
        return pd.DataFrame(out, columns=["graph_id", "g_t", "ap_id", "due", *_FIELDS])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, graph, fits = None, None, {}
        for pdf in batches:
            for m in pdf.itertuples():
                if m.graph_id != graph:
                    yield rows(graph, state)
                    state, graph, fits = None, m.graph_id, {}
                state, _, _ = step(state, graph, int(m.seq), _rows(m.rows), settings, fits)
        yield rows(graph, state)

    return _in_order(statements).mapInPandas(run, STATES)
