"""The gated fold as a stateful streaming query."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import Settings
from ..operators.fold import step
from ..plans.replay import FINDINGS, _rows, dumped, loaded


def detected(messages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Findings of a stream of messages(graph_id, seq, rows), see `plans.replay.messages`, as each arrives.

    State is keyed by graph_id and lives in the state store; within a micro-batch a graph's messages go by seq.
    """
    names = [c.split()[0] for c in FINDINGS.split(", ")]

    def run(key: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        state = loaded(kept.get[0]) if kept.exists else None
        pdf, out, fits = pd.concat(list(batches)), [], {}
        for m in pdf.sort_values("seq", kind="stable").itertuples():
            state, found, code = step(state, key[0], int(m.seq), _rows(m.rows), settings, fits)
            if code is not None:
                out += [(key[0], m.seq, state["t"], code, *f) for f in found or [(None,) * 5]]
        kept.update((dumped(state),))
        yield pd.DataFrame(out, columns=names).astype({"stmt_ix": "Int32", "finding": "Int32"})

    return messages.groupBy("graph_id").applyInPandasWithState(run, FINDINGS, "state string", "append", GroupStateTimeout.NoTimeout)


def publish(findings: DataFrame, path: str, checkpoint: str, level: int = 3):
    """A query that appends the findings of reports at `level` or above to Parquet files at path, exactly once."""
    return findings.where(f"code >= {level}").writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
