"""Removal of passages of words that an earlier document has, by a count-min prefilter and an exact second pass.

A first pass counts the hashes of all windows of 13 words in partition sketches: cells that count none, one or more. Sketches
merge by cell, so a cell that isn't full proves that each of its windows is in one place only: estimates are never too
low. A second pass sends on only windows in full cells, named by 96 bits, and groups them exactly. A step of a task
keeps one document of each of its own repeats and settles the others where they are, as runs, so the shuffle gets a copied
text once from each step and no window is a hot key.

The sketch has about eight cells a window. What is broadcast is one bit a cell, in slices of at most SLICE cells; each slice is
a pass of its own. Beyond SLICES slices cells fill up: then more windows are grouped, and the result is the same.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WHITE, batch, byte_codes, materialise, mix, releasing, row_key, steps, utf8, word_hashes, words

#: Words of a window.
WINDOW = 13
#: Cells of a slice of the sketch, 64 MB as bits, and the most slices.
SLICE, SLICES = 1 << 29, 64
#: Cells of a group that is merged at once, and of a block, whose cells have 16-bit numbers.
GROUP, BLOCK = 1 << 22, 1 << 16
#: Cells for each byte of text: eight for each window of average text.
CELLS_PER_BYTE = 1.25
#: Bytes of text of a step, and windows that a task counts before it hands them on.
STEP, FLUSH = 4 << 20, 1 << 22

_U = np.uint64
_CODES = (byte_codes(11), byte_codes(1103))
_LAST_ID = (1 << 63) - 1
_KEY = "doc long, row long"
_CANDIDATE = pa.schema([("h", pa.int64()), ("h2_at", pa.int64()), ("doc", pa.int64()), ("row", pa.int64()), ("run", pa.int32())])


def _windows(one: np.ndarray, first: np.ndarray, width: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and start of the windows of a step whose words have the hashes `one`; windows stay within their row."""
    n = max(0, len(one) - width + 1)
    weights = mix(np.arange(seed, seed + width, dtype=_U)) | _U(1)
    total = np.zeros(n, _U)
    for j in range(width):
        total += one[j : j + n] * weights[j]
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(row[:n] == row[width - 1 :]) if n else np.empty(0, np.int64)
    return mix(total[at]), row[at], at


def _cells(hashes: np.ndarray, cells: int) -> np.ndarray:
    """The cell of each hash; cells is a power of two."""
    return (hashes >> _U(64 - int(math.log2(cells)))).astype(np.int64)


def partition_sketch(cells: np.ndarray, group: int) -> pa.RecordBatch:
    """(grp, block, cells) of cell numbers, at most two of each: the blocks that have any, as 16-bit numbers in them."""
    cells = np.sort(cells)
    third = np.zeros(len(cells), bool)
    third[2:] = cells[2:] == cells[:-2]
    cells = cells[~third]
    block = cells // BLOCK
    begin = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(cells) else np.empty(0, np.int64)
    ends = 2 * np.concatenate([begin, [len(cells)]]).astype(np.int32)
    binary = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer((cells % BLOCK).astype(np.uint16))])
    number = block[begin]
    return pa.RecordBatch.from_arrays([pa.array(number // (group // BLOCK)), pa.array(number), binary], names=["grp", "block", "cells"])


def merged(rows: DataFrame, group: int) -> DataFrame:
    """(grp, full) of partition sketches: a bit for each cell of a group that counts more than one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, own = np.zeros(group, np.uint8), None
        full = lambda: pa.RecordBatch.from_arrays([pa.array([own], pa.int64()), pa.array([np.packbits(count > 1).tobytes()], pa.binary())], names=["grp", "full"])
        for b in batches:
            groups = b.column("grp").to_numpy()
            for lo, hi in zip(edges := np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]])) if len(groups) else [], [*edges[1:], len(groups)], strict=True):
                if groups[lo] != own:
                    if own is not None:
                        yield full()
                    own = int(groups[lo])
                    count[:] = 0
                for block, cells in zip(b.column("block").slice(lo, hi - lo).to_pylist(), b.column("cells").slice(lo, hi - lo).to_pylist(), strict=True):
                    got = np.frombuffer(cells, np.uint16)
                    base = block % (group // BLOCK) * BLOCK
                    again = np.zeros(len(got), bool)
                    again[1:] = got[1:] == got[:-1]
                    at = base + got[~again].astype(np.int64)
                    count[at] = np.minimum(count[at] + 1, 2)
                    count[base + got[again].astype(np.int64)] = 2
        if own is not None:
            yield full()

    return rows.repartition("grp").sortWithinPartitions("grp").mapInArrow(releasing(run), "grp long, full binary")


def sketch(texts: DataFrame, cells: int, group: int, width: int = WINDOW) -> DataFrame:
    """merged() partition sketches of all windows of texts(text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, n = [], 0
        for rows in batches:
            data, offsets = utf8(rows.column("text"))
            for lo, hi in steps(offsets):
                part, own = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                starts, ends, first = words(part, own)
                hashes, _, _ = _windows(word_hashes(part, starts, ends, _CODES[0]), first, width, 17)
                kept.append(_cells(hashes, cells).astype(np.uint32 if cells <= 1 << 32 else np.int64))
                n += len(hashes)
                if n >= FLUSH:
                    yield partition_sketch(np.concatenate(kept).astype(np.int64), group)
                    kept, n = [], 0
        if n:
            yield partition_sketch(np.concatenate(kept).astype(np.int64), group)

    return merged(texts.select("text").mapInArrow(releasing(run), "grp long, block long, cells binary"), group)


def _bits(rows: list, slice_cells: int, group: int) -> np.ndarray:
    """The bits of one slice from its groups' rows; groups without windows have none."""
    bits, size = np.zeros(slice_cells // 8, np.uint8), group // 8
    for r in rows:
        at = r["grp"] * size % len(bits)
        bits[at : at + size] = np.frombuffer(r["full"], np.uint8)
    return bits


def candidates(keyed: DataFrame, bits: Broadcast, part: int, parts: int, cells: int, width: int = WINDOW) -> DataFrame:
    """(h, h2_at, doc, row, run) of keyed(doc, row, text): windows of slice `part` in full cells.

    run 0: one window, by its 64-bit hash, 32 more bits of another, and its start. Of a step's equal windows only those of
    the least document are sent on; the others are settled, as runs of `run` starts beginning at the one given.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full, salt = bits.value, 0
        for rows in batches:
            data, offsets = utf8(rows.column("text"))
            doc, key = rows.column("doc").to_numpy(), rows.column("row").to_numpy()
            for lo, hi in steps(offsets, STEP):
                text, own = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                starts, ends, first = words(text, own)
                hashes, row, at = _windows(word_hashes(text, starts, ends, _CODES[0]), first, width, 17)
                cell = _cells(hashes, cells)
                mine = cell // (cells // parts) == part
                inner = cell % (cells // parts)
                mine &= (full[inner >> 3] >> (7 - (inner & 7)).astype(np.uint8) & 1).astype(bool)
                pick = np.flatnonzero(mine)
                if not len(pick):
                    continue
                other = _windows(word_hashes(text, starts, ends, _CODES[1]), first, width, 1017)[0][pick]
                h, row, at = hashes[pick], row[pick], at[pick]
                place, owner = at - first[row], doc[lo:hi][row]
                order = np.lexsort((owner, other, h))
                new = np.ones(len(order), bool)
                new[1:] = (h[order][1:] != h[order][:-1]) | (other[order][1:] != other[order][:-1])
                least = np.empty(len(order), np.int64)
                least[order] = owner[order][np.flatnonzero(new)][np.cumsum(new) - 1]
                known = owner > least
                if (~known).any():
                    i = np.flatnonzero(~known)
                    packed = (other[i] & _U(0xFFFFFFFF00000000)) | place[i].astype(_U)
                    yield batch({"h": h[i].view(np.int64), "h2_at": packed.view(np.int64), "doc": owner[i], "row": key[lo:hi][row[i]], "run": np.zeros(len(i), np.int32)}, _CANDIDATE)
                if known.any():
                    i = np.flatnonzero(known)
                    begin = np.flatnonzero(np.concatenate([[True], (np.diff(at[i]) != 1) | (np.diff(row[i]) != 0)]))
                    size = np.diff(np.concatenate([begin, [len(i)]]))
                    i = i[begin]
                    spread = mix(np.arange(salt, salt + len(i), dtype=_U) + key[lo:hi][row[i]].view(_U))  # runs need no group
                    salt += len(i)
                    yield batch({"h": spread.view(np.int64), "h2_at": place[i], "doc": owner[i], "row": key[lo:hi][row[i]], "run": size.astype(np.int32)}, _CANDIDATE)

    return keyed.mapInArrow(releasing(run), f"h long, h2_at long, {_KEY}, run int")


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WINDOW) -> DataFrame:
    """(doc, row, runs): for each row with windows that a document of a lesser id has, too, their starts, as (start, count).

    row is row_key(); doc the id, or the largest long if it is null: such rows yield to all others. Rows of one id don't yield to
    one another, so that equal rows have equal results.
    """
    spark = docs.sparkSession
    keyed = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST_ID)).alias("doc"), row_key(doc_id, text).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n_bytes = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = 1 << min(max(20, round(math.log2(max(1, n_bytes) * CELLS_PER_BYTE))), int(math.log2(SLICE * SLICES)))
    parts = max(1, cells // SLICE)
    group = min(GROUP, cells // parts)
    counted = materialise(sketch(keyed, cells, group, width))
    found = None
    for part in range(parts):
        mine = counted if parts == 1 else counted.where((F.col("grp") >= part * (SLICE // group)) & (F.col("grp") < (part + 1) * (SLICE // group)))
        bits = spark.sparkContext.broadcast(_bits(mine.collect(), cells // parts, group))  # of fixed size: SLICE bits at most
        sent = candidates(keyed, bits, part, parts, cells, width)
        lowest = F.min("doc").over(W.partitionBy("h", (F.col("h2_at").bitwiseAND(F.lit(-1 << 32)))))
        judged = sent.withColumn("lowest", lowest).where("run > 0 or doc > lowest")
        start = F.col("h2_at").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
        runs = judged.groupBy("doc", "row").agg(F.array_sort(F.collect_set(F.struct(start.alias("at"), F.greatest("run", F.lit(1)).alias("n")))).alias("runs"))
        runs = materialise(runs)
        bits.destroy()
        found = runs if found is None else found.unionByName(runs)
    return found if parts == 1 else materialise(found.groupBy("doc", "row").agg(F.flatten(F.collect_list("runs")).alias("runs")))


def _kept_words(starts: np.ndarray, first: np.ndarray, runs: pa.Array, width: int) -> np.ndarray:
    """Which words of a step stay; runs: (at, n) lists of starts for each row."""
    cover = np.zeros(len(starts) + 1, np.int64)
    counts = np.diff(runs.offsets.to_numpy()) if len(runs) else np.zeros(0, np.int64)
    flat = runs.flatten()
    if len(flat):
        base = np.repeat(first[:-1], np.where(runs.is_valid().to_numpy(zero_copy_only=False), counts, 0))
        at = flat.field("at").to_numpy(zero_copy_only=False).astype(np.int64) + base
        np.add.at(cover, at, 1)
        np.add.at(cover, at + flat.field("n").to_numpy(zero_copy_only=False) + width - 1, -1)
    return np.cumsum(cover[:-1]) == 0


def rebuilt(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, offsets: np.ndarray, keep: np.ndarray) -> list[bytes]:
    """The kept words of each row of a step, joined by one space."""
    data, edge = np.where(WHITE[data], np.uint8(0x20), data), np.zeros(len(data) + 2, np.int8)
    last = np.zeros(len(data) + 2, bool)
    last[offsets[1:]] = True
    after = np.where(last[ends], ends, ends + 1)  # with the white byte that follows, if the row has one
    np.add.at(edge, starts[keep], 1)
    np.add.at(edge, after[keep], -1)
    mask = np.cumsum(edge[: len(data)]) > 0
    flat, places = data[mask].tobytes(), np.concatenate([[0], np.cumsum(mask)])[offsets]
    return [flat[a:b].rstrip(b" ") for a, b in zip(places[:-1], places[1:], strict=True)]


def _applied(docs: DataFrame, run, schema: str, doc_id: str, text: str, width: int) -> DataFrame:
    """run over docs with _runs, what repeats() found for each row."""
    found = repeats(docs, doc_id, text, width).select(F.col("row").alias("_row"), F.col("doc").alias("_doc"), F.col("runs").alias("_runs"))
    with_key = docs.withColumn("_row", row_key(doc_id, text)).withColumn("_doc", F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST_ID)))
    return with_key.join(found, ["_row", "_doc"], "left").mapInArrow(releasing(run), schema)


def digest(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), a row for each row of docs.

    A null text has no words, nor has an empty one; fewer than 13 words have no window. A null id counts as the largest. Rows of
    one id don't remove one another's words, so repeated rows have equal results. A text of any length is read whole; a step
    holds one at least. An empty table gives no rows, and extra columns don't matter.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            data, offsets = utf8(rows.column("text"))
            for lo, hi in steps(offsets):
                part, own = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                starts, ends, first = words(part, own)
                keep = _kept_words(starts, first, pa.concat_arrays([rows.column("_runs").slice(lo, hi - lo)]), width)
                gone = np.concatenate([[0], np.cumsum(~keep)])[first]
                names = [hashlib.sha256(x).hexdigest() for x in rebuilt(part, starts, ends, own, keep)]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id").slice(lo, hi - lo), pa.array(np.diff(first)), pa.array(np.diff(gone)), pa.array(names, pa.string())], schema=schema)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _applied(slim, run, "doc_id long, n_words long, n_removed long, kept_sha256 string", "doc_id", "text", width)


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WINDOW) -> DataFrame:
    """docs with the words of later copies cut out of text; texts that lose none stay as they are. Same columns, same rows."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            data, offsets = utf8(rows.column("_text"))
            for lo, hi in steps(offsets):
                part, own = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                starts, ends, first = words(part, own)
                keep = _kept_words(starts, first, pa.concat_arrays([rows.column("_runs").slice(lo, hi - lo)]), width)
                lost = np.diff(np.concatenate([[0], np.cumsum(~keep)])[first]) > 0
                old = rows.column("_text").slice(lo, hi - lo).to_pylist()
                new = [x.decode() if gone else was for x, gone, was in zip(rebuilt(part, starts, ends, own, keep), lost, old, strict=True)]
                yield pa.RecordBatch.from_arrays([*[rows.column(f"_c{i}").slice(lo, hi - lo) for i in range(len(names))], pa.array(new, pa.string())], names=[*[f"_c{i}" for i in range(len(names))], "_new"])

    # positions as names: columns of any name can't clash with ours
    own = docs.select(*[F.col(f"`{n}`").alias(f"_c{i}") for i, n in enumerate(names)], F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").alias("_text"))
    schema = ", ".join([*[f"_c{i} {t}" for i, (_, t) in enumerate(docs.dtypes)], "_new string"])
    out = _applied(own, run, schema, "_id", "_text", width)
    return out.select(*[(F.col("_new") if n == text else F.col(f"_c{i}")).alias(n) for i, n in enumerate(names)])


def oracle_sql() -> str:
    """Windows as joined words, grouped by their text."""
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
v AS MATERIALIZED (SELECT row, doc, k, sha256(array_to_string(list_slice(w, k, k + {WINDOW - 1}), ' ')) AS name FROM (SELECT row, coalesce(doc_id, {_LAST_ID}) AS doc, w, unnest(range(1, len(w) - {WINDOW - 2})) AS k FROM d)),
r AS MATERIALIZED (SELECT DISTINCT row, unnest(range(k, k + {WINDOW})) AS k FROM v JOIN (SELECT name, min(doc) AS low FROM v GROUP BY name) USING (name) WHERE doc > low),
t AS (SELECT row, count(r.k) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY e.k) FILTER (WHERE r.k IS NULL), '') AS kept FROM (SELECT row, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d) e LEFT JOIN r USING (row, k) GROUP BY row)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN t USING (row)"""
