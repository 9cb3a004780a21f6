"""Removal of long byte strings that occur elsewhere in the corpus, by run-length indexes of its repetitive parts.

Any 200-byte window has an anchor: its 32-byte gram of least hash, the leftmost of equals. Anchors depend on the
window's bytes alone, so equal windows have equal anchors, and windows that share an anchor occurrence form one segment.
Only segments whose anchor occurs again can hold a repeat. Equal segments are counted before they are shuffled; the
distinct ones of each anchor are gathered, and a run-compressed Burrows-Wheeler index of them says which windows repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RangeHash, batch, byte_codes, materialise, releasing, row_key, steps, utf8

#: Bytes of a repeat, and of an anchor.
LENGTH, GRAM = 200, 32
#: Distinct segments of one anchor beyond which its windows are dealt out by their content.
CROWD = 16_384
#: Bytes that one run-length index covers.
INDEX_BYTES = 1 << 19
#: Bytes of text in which segments are looked for at once.
STRIP = 1 << 20

_U = np.uint64
_POS = 22
_SEGMENTS = pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("rk", pa.int64()), ("start", pa.int64()), ("windows", pa.int32())])
_SPANS = pa.schema([("rk", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
_CODES = byte_codes(2)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done < width:
        hop = min(done, width - done)
        x = np.minimum(x[: len(x) - hop], x[hop:])
        done += hop
    return x


def _segments_of(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, start in row, windows, anchor, content) of the segments of the rows in one step; long rows go in strips."""
    row_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for lo in range(0, max(1, len(data)), STRIP):
        part = data[lo : lo + STRIP + length - 1]
        if len(part) < length:
            continue
        hashed = RangeHash(part, _CODES)
        at = np.arange(len(part) - gram + 1)
        grams = hashed(at, at + gram)
        packed = (grams & ~_U((1 << _POS) - 1)) | at.astype(_U)
        least = (_sliding_min(packed, length - gram + 1) & _U((1 << _POS) - 1)).astype(np.int64)
        # windows that lie in one row
        start = np.arange(len(least))
        row = row_of[lo : lo + len(least)]
        good = start + lo + length <= offsets[row + 1]
        new = np.ones(len(least), dtype=bool)
        new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1]) | ~good[:-1]
        first = np.flatnonzero(new & good)
        if not len(first):
            continue
        # a segment ends before the next one or before the first window that leaves the row
        cut = np.flatnonzero(new | ~good)
        after = np.searchsorted(cut, first, side="right")
        end = np.where(after < len(cut), cut[np.minimum(after, len(cut) - 1)], len(least))
        yield row[first], first + lo - offsets[row[first]], end - first, grams[least[first]], hashed(first, end + length - 1)


def segments(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(anchor, content, rk, start, windows) of every segment of docs(rk, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            rk = rows.column("rk").to_numpy(zero_copy_only=False)
            data, offsets = utf8(rows.column("text"))
            for first, last in steps(offsets, STRIP):
                for row, start, windows, anchor, content in _segments_of(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], length, gram):
                    yield batch({"anchor": anchor.view(np.int64), "content": content.view(np.int64), "rk": rk[first + row], "start": start, "windows": windows.astype(np.int32)}, _SEGMENTS)

    return docs.select("rk", "text").mapInArrow(releasing(run), "anchor long, content long, rk long, start long, windows int")


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of some strings, with the text position sampled at both ends of each run.

    The suffix before (after) a given one in order shares a prefix with it that is by one byte shorter than the one its
    left neighbour shares, except at run heads (tails). So sampled run ends and the prefix lengths there give the matching
    statistics of the whole text against the rest of it in one pass from left to right.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        """data: the strings, one after the other; a sign of its own, below all bytes, follows each."""
        n, m = len(data), len(offsets) - 1
        string = np.repeat(np.arange(m), np.diff(offsets))
        size = n + m
        where = np.arange(n) + string  # of each byte, with the signs in place
        text = np.zeros(size, np.int64)
        text[where] = data.astype(np.int64) + m
        text[offsets[1:] + np.arange(m)] = np.arange(m)
        self.end = np.empty(size, np.int64)  # of its string, for each position
        self.end[where] = (offsets[1:] + np.arange(m))[string]
        self.end[offsets[1:] + np.arange(m)] = offsets[1:] + np.arange(m)
        # suffix order by prefix doubling, from as many signs as 63 bits hold; no two suffixes are equal, since the signs differ
        base = m + 256
        done = max(1, int(63 / np.log2(base)))
        key = np.zeros(size, np.int64)
        for hop in range(done):
            key *= base
            key[: size - hop] += text[hop:]
        order = np.argsort(key)
        in_order = key[order]
        rank = np.empty(size, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(in_order[1:] != in_order[:-1])])
        while rank[order[-1]] < size - 1:
            second = np.zeros(size, np.int64)
            second[: max(0, size - done)] = rank[done:] + 1
            key = rank * (size + 1) + second
            order = np.argsort(key)
            in_order = key[order]
            rank[order] = np.concatenate([[0], np.cumsum(in_order[1:] != in_order[:-1])])
            done *= 2
        bwt = text[order - 1]  # before position 0 comes the last sign
        head = np.concatenate([[True], bwt[1:] != bwt[:-1]])
        head |= bwt < m  # signs differ from each other, and so do their runs
        heads = np.flatnonzero(head)
        self.runs = bwt[heads]
        self.heads, self.tails = order[heads], order[np.concatenate([heads[1:], [size]]) - 1]
        before = np.where(heads > 0, order[heads - 1], -1)
        tails = np.concatenate([heads[1:], [size]])
        after = np.where(tails < size, order[np.minimum(tails, size - 1)], -1)
        self.head_match = self._common(text, self.heads, before)
        self.tail_match = self._common(text, self.tails, after)
        self.size, self.where = size, where

    def _common(self, text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the prefix that the suffixes at a and b share; 0 where b is -1. Signs never match."""
        length = np.zeros(len(a), np.int64)
        live = np.flatnonzero(b >= 0)
        while len(live):
            same = text[a[live] + length[live]] == text[b[live] + length[live]]
            live = live[same]
            length[live] += 1
        return length

    def matching_statistics(self) -> np.ndarray:
        """For each byte: how long a prefix of its suffix, within its string, also starts elsewhere in the strings."""
        best = np.zeros(self.size, np.int64)
        for sample, match in ((self.heads, self.head_match), (self.tails, self.tail_match)):
            value = np.full(self.size, -1, np.int64)
            value[sample] = sample + match
            last = np.maximum.accumulate(np.where(value >= 0, np.arange(self.size), -1))
            reach = np.where(last >= 0, value[np.maximum(last, 0)], 0) - np.arange(self.size)
            best = np.maximum(best, reach)
        return best[self.where]


def _runs(flags: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true flags; no run goes over a break."""
    edge = np.zeros(len(flags) + 1, dtype=bool)
    edge[breaks] = True
    first = np.flatnonzero(flags & (edge[:-1] | ~np.concatenate([[False], flags[:-1]])))
    last = np.flatnonzero(flags & (edge[1:] | ~np.concatenate([flags[1:], [False]])))
    return first, last + 1


def _judge(rows: pa.Table, length: int) -> pa.RecordBatch:
    """The spans of the segments with one occurrence whose windows repeat in another segment."""
    data, offsets = utf8(rows.column("bytes").combine_chunks().cast(pa.binary()).view(pa.string()))
    statistics = RunLengthIndex(data, offsets).matching_statistics()
    first, end = _runs(statistics >= length, offsets)
    string = np.searchsorted(offsets, first, side="right") - 1
    once = rows.column("copies").to_numpy()[string] == 1
    first, end, string = first[once], end[once], string[once]
    at = rows.column("start").to_numpy()[string] - offsets[string]
    return batch({"rk": rows.column("rk").to_numpy()[string], "start": first + at, "end": end + at + length - 1}, _SPANS)


def indexed_spans(contested: DataFrame, length: int = LENGTH) -> DataFrame:
    """(rk, start, end) of repeats among contested(anchor, rk, start, copies, bytes): distinct segments that share anchors.

    Whole anchors are gathered by their hash; each task indexes INDEX_BYTES of them at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for rows in batches:
            anchor = rows.column("anchor").to_numpy(zero_copy_only=False)
            lengths = np.diff(utf8(rows.column("bytes").cast(pa.binary()).view(pa.string()))[1])
            cut = 0
            for i in np.flatnonzero(np.concatenate([[last != anchor[0]], anchor[1:] != anchor[:-1]])) if len(anchor) else []:
                size_here = size + int(lengths[cut:i].sum())
                if size_here >= INDEX_BYTES:
                    held.append(rows.slice(cut, i - cut))
                    yield _judge(pa.Table.from_batches(held), length)
                    held, size, cut = [], 0, i
            held.append(rows.slice(cut))
            size += int(lengths[cut:].sum())
            last = anchor[-1] if len(anchor) else last
        if sum(len(x) for x in held):
            yield _judge(pa.Table.from_batches(held), length)

    return contested.select("anchor", "rk", "start", "copies", "bytes").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(releasing(run), "rk long, start long, end long")


def _cut(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """wanted(rk, anchor, start, windows, copies, ...) with the bytes of each segment."""
    text = docs.select("rk", F.col("text").cast("binary").alias("raw")).dropDuplicates(["rk"])
    return wanted.join(text, "rk").select("anchor", "rk", "start", "windows", "copies", F.expr(f"substring(raw, cast(start + 1 as int), windows + {LENGTH - 1})").alias("bytes"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(rk, start, end): byte ranges of docs(rk, text) covered by a LENGTH-byte string that starts anywhere else too.

    Ranges may overlap. Repeated rows (same rk) count as copies of each other.
    """
    # written first: a join of two plain shuffles can split a hot anchor, one with an aggregate below it can't
    again = materialise(segments(docs).groupBy("anchor").count().where("count > 1").select("anchor", F.col("count").alias("total")))
    found = materialise(segments(docs).join(again, "anchor"))
    copies = found.groupBy("anchor", "content").agg(F.count("*").alias("copies"), F.min(F.struct("rk", "start", "windows")).alias("one"), F.first("total").alias("total"))
    copies = materialise(copies)
    # segments that occur twice repeat as a whole; the others of a shared anchor go to the index, one of each
    whole = found.join(copies.where("copies > 1").select("anchor", "content"), ["anchor", "content"], "left_semi").select("rk", "start", (F.col("start") + F.col("windows") + LENGTH - 1).alias("end"))
    mixed = copies.where("copies < total").select("anchor", "one.*", "copies")
    crowds = materialise(mixed.groupBy("anchor").count().where(f"count > {CROWD}").select("anchor"))
    wanted = materialise(_cut(mixed, docs))
    if crowds.limit(1).count():  # the windows of a crowd go to the index dealt out by their content: equal ones meet
        apart = wanted.join(crowds, "anchor").select("anchor", "rk", "copies", "start", "bytes", F.explode(F.expr("sequence(0, windows - 1)")).alias("i")).select("rk", "copies", (F.col("start") + F.col("i")).alias("start"), F.expr(f"substring(bytes, i + 1, {LENGTH})").alias("bytes")).withColumn("anchor", F.xxhash64("bytes"))
        wanted = wanted.join(crowds, "anchor", "left_anti").select("anchor", "rk", "start", "copies", "bytes").unionByName(apart.select("anchor", "rk", "start", "copies", "bytes"))
    return whole.unionByName(indexed_spans(wanted))


def merged(spans: list[tuple[int, int]] | None) -> list[tuple[int, int]]:
    """Maximal ranges covered by sorted or unsorted spans; ranges that touch are one."""
    out: list[list[int]] = []
    for start, end in sorted(spans or []):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def _kept(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for start, end in spans:
        parts.append(raw[at:start])
        at = end
    return b"".join([*parts, raw[at:]])


def whole_characters(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans without the characters that they cover in part."""
    out = []
    for start, end in spans:
        while start < end and raw[start] & 0xC0 == 0x80:
            start += 1
        if end < len(raw):
            while end > start and raw[end] & 0xC0 == 0x80:
                end -= 1
        if start < end:
            out.append((start, end))
    return out


def with_spans(docs: DataFrame) -> DataFrame:
    """docs with rk and `spans`, the repeated ranges of each row (null: none)."""
    keyed = docs.withColumn("rk", row_key())
    spans = repeated_spans(keyed.select("rk", "text")).distinct().groupBy("rk").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return keyed.join(spans, "rk", "left")


def digest(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256. A null text is empty; a repeated row is a copy of its twin,
    so its repeated strings go from both; extra columns are ignored; an empty table gives an empty result."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out: dict[str, list] = {f.name: [] for f in schema}
            for doc_id, raw, spans in zip(rows.column("doc_id").to_pylist(), rows.column("raw"), rows.column("spans").to_pylist(), strict=True):
                data = raw.as_buffer() if raw.is_valid else b""
                ranges = merged([(s["start"], s["end"]) for s in spans or []])
                kept = _kept(memoryview(data), ranges) if ranges else data
                out["doc_id"].append(doc_id)
                out["n_bytes"].append(len(memoryview(data)))
                out["n_removed"].append(sum(b - a for a, b in ranges))
                out["n_spans"].append(len(ranges))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            yield batch(out, schema)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return with_spans(docs).select("doc_id", F.col("text").cast("binary").alias("raw"), "spans").mapInArrow(releasing(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs with the repeated strings cut out of text and n_chars counted anew; characters covered in part stay.
    A null text stays null; columns and their order are those of docs."""
    names = docs.columns

    @F.pandas_udf("string")
    def cut(text, spans):
        out = []
        for t, s in zip(text, spans, strict=True):
            if t is None or s is None or not len(s):
                out.append(t)
                continue
            raw = t.encode()
            out.append(_kept(raw, whole_characters(raw, merged([(x["start"], x["end"]) for x in s]))).decode())
        import pandas as pd

        return pd.Series(out, dtype=object)

    apart = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("doc_id"), F.col("text"))
    out = with_spans(apart).withColumn("text", cut("text", "spans")).select("row.*", F.col("text").alias("\x00text"))
    fix = {"text": F.col("`\x00text`"), **({"n_chars": F.when(F.col("`\x00text`").isNotNull(), F.char_length("`\x00text`").cast("long")).otherwise(F.col("n_chars"))} if "n_chars" in names else {})}
    return out.select(*[fix.get(c, F.col(f"`{c}`")).alias(c) for c in names])
