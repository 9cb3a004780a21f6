"""Vector codes: each part of a vector becomes the number of its nearest codebook entry.

The codebooks are fitted by integer k-means with the adaptive distance bounds of Drake and Hamerly. A part keeps, from round to
round, its entry with an upper bound, its b next closest entries with a lower bound each, and one outer bound for all others.
After the entries have moved, bounds move by as much. Where the upper bound is under all lower ones the part stays and no
distance is computed; else the listed entries up to the first bound that is larger, or all entries if there is none, are
compared by exact integer distances. Bounds are rounded away from each decision, so the result is that of plain k-means. b
begins at a quarter of the entries and falls to what nine tenths of the uncertain parts needed, an eighth at least.

State is a table in the shared folder, a row for each vector; a round reads one and writes the next, with the sums of each
task, and the one before is deleted. The driver holds codebooks only: entries x width integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, releasing, remove, shared_dir

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Share of the uncertain parts whose checks must fit into the next round's b bounds.
COVERED = 0.9

_UP, _DOWN = np.float32(np.inf), np.float32(-np.inf)


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> tuple[DataFrame, int]:
    """(vec_id, label, x) of the vectors without null or non-finite components, and the width of a part.

    x holds floor(SCALE * component). Vectors are padded with zeros to one length, the least multiple of PARTS that none exceeds.
    Components are cut off where squared distances would leave 64 bits: for parts of 8 that is beyond 2^26.
    """
    e = F.col(embedding)
    bad = F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    kept = vectors.where(e.isNotNull() & ~bad).select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), e.cast("array<double>").alias("e"))
    longest = kept.agg(F.max(F.size("e"))).first()[0] or 1
    width = -(-max(longest, 1) // PARTS)
    most = float(isqrt(2**58 // width) // 2)
    whole = F.transform("e", lambda v: F.floor(F.greatest(F.lit(-most), F.least(F.lit(most), v * SCALE))).cast("int"))
    return kept.select("vec_id", "label", F.concat(whole, F.array_repeat(F.lit(0), F.lit(width * PARTS) - F.size("e"))).alias("x")), width


def first_codebooks(ints: DataFrame, width: int, entries: int = ENTRIES) -> np.ndarray:
    """The parts of the vectors with the smallest ids, (parts, entries, width); null ids come last, ties go by vector."""
    rows = ints.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    return np.array([r.x for r in rows], np.int64).reshape(len(rows), PARTS, width).transpose(1, 0, 2)


def _all_distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to all entries."""
    largest = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    if largest**2 * 4 * x.shape[1] < 2**52:
        a, b = x.astype(np.float64), book.astype(np.float64)
        return ((a**2).sum(1)[:, None] - 2 * (a @ b.T) + (b**2).sum(1)).astype(np.int64)
    return sum((x[:, None, c] - book[None, :, c]) ** 2 for c in range(x.shape[1]))


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), _UP)


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), _DOWN)


class Bounds:
    """What is known of one part of each row of a batch: own entry, upper bound, b ids with lower bounds, outer bound."""

    def __init__(self, own: np.ndarray, upper: np.ndarray, ids: np.ndarray, lower: np.ndarray, outer: np.ndarray):
        self.own, self.upper, self.ids, self.lower, self.outer = own, upper, ids, lower, outer

    @classmethod
    def empty(cls, n: int, b: int) -> Bounds:
        return cls(np.zeros(n, np.uint8), np.zeros(n, np.float32), np.zeros((n, b), np.uint8), np.zeros((n, b), np.float32), np.zeros(n, np.float32))

    def search(self, rows: np.ndarray, x: np.ndarray, book: np.ndarray) -> None:
        """Own entry, ids and bounds of some rows from the distances to all entries."""
        b, k = self.ids.shape[1], len(book)
        far = _all_distances(x[rows], book)
        key = far * ENTRIES + np.arange(k)
        order = np.argsort(key, axis=1) if k <= ENTRIES else np.lexsort((np.broadcast_to(np.arange(k), far.shape), far))
        root = np.sqrt(np.take_along_axis(far, order, 1).astype(np.float64))
        self.own[rows], self.upper[rows] = order[:, 0], _up(root[:, 0])
        self.ids[rows], self.lower[rows] = order[:, 1 : b + 1], _down(root[:, 1 : b + 1])
        self.outer[rows] = _down(root[:, b + 1]) if k > b + 1 else np.inf

    def narrowed(self, b: int) -> None:
        """Keeps b listed entries; the outer bound then covers the others, too."""
        if b < self.ids.shape[1]:
            self.outer = np.minimum(self.outer, self.lower[:, b:].min(1))
            self.ids, self.lower = self.ids[:, :b], self.lower[:, :b]

    def moved(self, x: np.ndarray, book: np.ndarray, by: np.ndarray) -> np.ndarray:
        """Brings the bounds to entries that have moved by `by`; how many bounds each row needed (0: none; b + 1: all entries)."""
        b = self.ids.shape[1]
        self.upper = _up(self.upper + by[self.own])
        self.lower = _down(self.lower - by[self.ids])
        self.outer = _down(self.outer - by.max())
        ordered = np.minimum.accumulate(np.column_stack([self.lower, self.outer])[:, ::-1], axis=1)[:, ::-1]
        need = (self.upper[:, None] >= ordered).sum(1)
        for m in range(1, b + 1):
            rows = np.flatnonzero(need == m)
            if len(rows):
                near = np.column_stack([self.own[rows], self.ids[rows, :m]]).astype(np.int64)
                far = ((x[rows][:, None, :] - book[near]) ** 2).sum(2)
                order = np.argsort(far * ENTRIES + near, axis=1)
                near, root = np.take_along_axis(near, order, 1), np.sqrt(np.take_along_axis(far, order, 1).astype(np.float64))
                self.own[rows], self.upper[rows] = near[:, 0], _up(root[:, 0])
                self.ids[rows, :m], self.lower[rows, :m] = near[:, 1:], _down(root[:, 1:])
        self.search(np.flatnonzero(need == b + 1), x, book)
        return need


def _packed(parts: list[Bounds]) -> pa.Array:
    """A binary value for each row: own entries, ids, upper, lower and outer bounds of all parts."""
    n = len(parts[0].own)
    whole = [np.column_stack([p.own for p in parts]), np.column_stack([p.ids for p in parts])]
    real = np.column_stack([np.column_stack([p.upper for p in parts]), *[p.lower for p in parts], np.column_stack([p.outer for p in parts])]).astype(np.float32)
    flat = np.ascontiguousarray(np.column_stack([*whole, np.ascontiguousarray(real).view(np.uint8).reshape(n, -1)]))
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(flat.shape[1]), n, [None, pa.py_buffer(flat)]).cast(pa.binary())


def _unpacked(column: pa.Array, b: int) -> list[Bounds]:
    n = len(column)
    flat = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(n, -1)
    own, ids = flat[:, :PARTS], flat[:, PARTS : PARTS * (1 + b)].reshape(n, PARTS, b)
    real = np.ascontiguousarray(flat[:, PARTS * (1 + b) :]).view(np.float32).reshape(n, PARTS * (2 + b))
    lower = real[:, PARTS : PARTS * (1 + b)].reshape(n, PARTS, b)
    return [Bounds(own[:, p].copy(), real[:, p].copy(), ids[:, p].copy(), lower[:, p].copy(), real[:, PARTS * (1 + b) + p].copy()) for p in range(PARTS)]


def _ints(column: pa.Array, width: int) -> np.ndarray:
    """(rows, parts, width) of a column of integer lists."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), PARTS, width)


class Round:
    """One assignment of all rows, as a job: the task code gets the codebooks, what they moved by, and how many bounds to keep."""

    def __init__(self, books: np.ndarray, by: np.ndarray | None, had: int, b: int, last: bool):
        self.books, self.by, self.had, self.b, self.last = books, by, had, b, last

    def assigned(self, rows: pa.RecordBatch) -> tuple[np.ndarray, list[Bounds], np.ndarray]:
        """The integers, the bounds, and a histogram of how many bounds the parts needed."""
        x, used = _ints(rows.column("x"), self.books.shape[2]), np.zeros(ENTRIES + 2, np.int64)
        parts = [Bounds.empty(len(x), self.b) for _ in range(PARTS)] if self.by is None else _unpacked(rows.column("bounds"), self.had)
        for p, own in enumerate(parts):
            if self.by is None:
                own.search(np.arange(len(x)), x[:, p], self.books[p])
            else:
                own.narrowed(self.b)
                used += np.bincount(own.moved(x[:, p], self.books[p], self.by[p]), minlength=len(used))
        return x, parts, used

    def states(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows with new bounds; at a task's end one row with its sums."""
        k, width = self.books.shape[1:]
        sums, used, kinds = np.zeros((PARTS, k, width + 1), np.int64), np.zeros(ENTRIES + 2, np.int64), None
        for rows in batches:
            kinds = {n: rows.schema.field(n).type for n in ("vec_id", "label", "x")}
            if len(rows):
                x, parts, more = self.assigned(rows)
                used += more
                for p, own in enumerate(parts):
                    for c in range(width + 1):  # exact: a batch's sums stay under 2^53
                        sums[p, :, c] += np.bincount(own.own, weights=x[:, p, c - 1] if c else None, minlength=k).astype(np.int64)
                yield self._batch([*[rows.column(n) for n in kinds], _packed(parts), pa.nulls(len(rows), pa.list_(pa.int64()))])
        if kinds:
            yield self._batch([*[pa.nulls(1, t) for t in kinds.values()], pa.nulls(1, pa.binary()), pa.array([np.concatenate([sums.ravel(), used])], pa.list_(pa.int64()))])

    def codes(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """vec_id, label, code and error of the rows."""
        for rows in batches:
            if len(rows):
                x, parts, _ = self.assigned(rows)
                own = np.stack([p.own for p in parts], 1)
                error = sum(((x[:, p] - self.books[p][own[:, p]]) ** 2).sum(1) for p in range(PARTS))
                code = [bytes(r).hex() for r in own]
                yield pa.RecordBatch.from_arrays([rows.column("vec_id"), rows.column("label"), pa.array(code, pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    @staticmethod
    def _batch(columns: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "x", "bounds", "sums"])


def _kinds(df: DataFrame, *more: str) -> str:
    return ", ".join([*[f"{n} {dict(df.dtypes)[n]}" for n in ("vec_id", "label")], *more])


def coded(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of the kept vectors, and the codebooks, (parts, entries, width).

    entries: 16 at most; with fewer kept vectors there are as many entries as those.
    """
    if not 1 <= entries <= ENTRIES:
        raise ValueError(f"entries must be from 1 to {ENTRIES}")
    spark = vectors.sparkSession
    ints, width = quantised(vectors, vec_id, embedding, label)
    books = first_codebooks(ints, width, entries)
    if not books.size:
        return spark.createDataFrame([], _kinds(ints, "code string", "error long")), books
    state, path, by = ints, None, None
    most, least = min(max(1, entries // 4), books.shape[1] - 1), min(max(1, entries // 8), books.shape[1] - 1)
    had = b = most
    for _ in range(rounds):
        task = Round(books, by, had, b, False)
        new = shared_dir(spark)
        state.mapInArrow(releasing(task.states), _kinds(ints, "x array<int>", "bounds binary", "sums array<long>")).write.parquet(new)
        if path:
            remove(spark, path)
        path, had = new, b
        whole = spark.read.parquet(path)
        state = whole.where("x is not null").select("vec_id", "label", "x", "bounds")
        rows = whole.where("sums is not null").select(F.posexplode("sums").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect()  # an integer for each entry's component
        flat = np.zeros(len(rows), np.int64)
        flat[[r["at"] for r in rows]] = [r["v"] for r in rows]
        used, sums = flat[-(ENTRIES + 2) :], flat[: -(ENTRIES + 2)].reshape(PARTS, books.shape[1], width + 1)
        count = sums[:, :, :1]
        new_books = np.where(count > 0, sums[:, :, 1:] // np.maximum(count, 1), books)
        by = np.sqrt(((new_books - books) ** 2).sum(2).astype(np.float64)) * (1 + 1e-12)
        books = new_books
        uncertain = used[1:].sum()
        if uncertain:
            needed = 1 + int(np.searchsorted(np.cumsum(used[1:]), COVERED * uncertain))
            b = max(least, min(b, needed))
    task = Round(books, by, had, b, True)
    out = materialise(state.mapInArrow(releasing(task.codes), _kinds(ints, "code string", "error long")))
    if path:
        remove(spark, path)
    return out, books


def digest(vectors: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of each kept row.

    Null vectors and those with a null, NaN or infinite component are dropped; an empty table gives no rows. Vectors of unequal
    or odd length are padded with zeros (see quantised). Rows with equal ids or vectors stay rows of their own; ids that are null
    count as the largest. Ties of distance go to the lower entry. Extra columns don't matter.
    """
    rows, books = coded(vectors)
    text = ",".join(map(str, books.reshape(-1).tolist()))
    name = lambda c: F.struct(F.col(c).isNull(), F.coalesce(F.col(c).cast("string"), F.lit("")))  # noqa: E731  a null label is a label
    named = rows.withColumn("name", name("label"))
    sums = materialise(named.groupBy("name").agg(F.sum("error").alias("label_error")))  # summed in each task first; its size is known to the join
    return named.join(sums, "name").select("vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(text.encode()).hexdigest()).alias("codebooks_sha256"))


def oracle_sql() -> str:
    """The same by plain k-means, a common table expression for each round."""
    kept = "len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0"
    head = f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, label, list_transform(embedding, lambda v: CAST(floor({SCALE} * CAST(v AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE embedding IS NOT NULL AND {kept}),
parts AS MATERIALIZED (SELECT row, vec_id, p, list_slice(x, p * (len(x) // {PARTS}) + 1, (p + 1) * (len(x) // {PARTS})) AS v FROM kept, (SELECT unnest(range({PARTS})) AS p)),
b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id, v) - 1 AS j, v AS c FROM parts QUALIFY j < {ENTRIES})"""
    far = "list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    for i in range(ROUNDS + 1):
        head += f",\na{i} AS MATERIALIZED (SELECT row, p, any_value(v) AS v, min({{'d': {far}, 'j': j}}) AS best FROM parts JOIN b{i} USING (p) GROUP BY row, p)"
        if i < ROUNDS:
            head += f",\nm{i} AS MATERIALIZED (SELECT p, best.j AS j, n, CAST(floor(sum(v[n]) / count(*)) AS BIGINT) AS c FROM a{i}, (SELECT unnest(range(1, 1 + (SELECT max(len(v)) FROM parts))) AS n) GROUP BY ALL), b{i + 1} AS MATERIALIZED (SELECT p, j, coalesce(u.c, b.c) AS c FROM b{i} b LEFT JOIN (SELECT p, j, list(c ORDER BY n) AS c FROM m{i} GROUP BY ALL) u USING (p, j))"
    books = f"(SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, j)) FROM b{ROUNDS})"
    return f"""{head},
r AS (SELECT row, string_agg(printf('%02x', best.j), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY row)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, {books} AS codebooks_sha256 FROM r JOIN kept USING (row)"""
