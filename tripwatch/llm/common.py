"""What the operators of this subpackage share: shared storage, row keys, words as numpy arrays."""

from __future__ import annotations

import ctypes
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step works on; a longer text is a step of its own.
STEP_BYTES = 2 << 20
#: Space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A word in Java's, Python's and DuckDB's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"

_U = np.uint64
_MIX1, _MIX2 = _U(0xFF51AFD7ED558CCD), _U(0xC4CEB9FE1A85EC53)
_BASE = 0x9E3779B97F4A7C15
_POWERS = {"n": 0, "up": np.empty(0, _U), "down": np.empty(0, _U)}


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; in local mode a temporary one where it is unset."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    top = top or tempfile.mkdtemp(prefix="tripwatch-")
    return f"{top.rstrip('/')}/tripwatch-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read again: it is computed once and has no lineage to lose."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """64 bits that name a row by its id and its text; repeated rows share them."""
    return F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("\x00null")), F.coalesce(F.col(text), F.lit("")))


def crc_remainder(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; 0 marks held-out rows. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5


def chosen(share: float | Column, *key: Column | str) -> Column:
    """Whether a row is in a sample of this share, by a 63-bit hash of its key: exact for any share, also one under a millionth."""
    limit = F.lit(share) if isinstance(share, float) else share
    return F.shiftrightunsigned(F.xxhash64(*key), 1) / float(1 << 63) < limit


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    x = x ^ (x >> _U(33))
    x = x * _MIX1
    x ^= x >> _U(33)
    x *= _MIX2
    x ^= x >> _U(33)
    return x


def byte_codes(seed: int, fold_case: bool = False) -> np.ndarray:
    """A random 64-bit code of each byte; with fold_case A-Z have the codes of a-z."""
    codes = mix(np.arange(1, 257, dtype=_U) * _U(_BASE) + _U(seed))
    if fold_case:
        codes[65:91] = codes[97:123]
    return codes


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2^64 and of its inverse."""
    if _POWERS["n"] < n:
        n = max(n, STEP_BYTES + (1 << 16))
        one = np.ones(1, _U)
        _POWERS["up"] = np.concatenate([one, np.cumprod(np.full(n, _BASE, _U))])
        _POWERS["down"] = np.concatenate([one, np.cumprod(np.full(n, pow(_BASE, -1, 1 << 64), _U))])
        _POWERS["n"] = n
    return _POWERS["up"], _POWERS["down"]


class RangeHash:
    """Hashes of any byte ranges of one buffer, from prefix sums of a polynomial modulo 2^64."""

    def __init__(self, data: np.ndarray, codes: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.empty(len(data) + 1, _U)
        self.sums[0] = 0
        np.cumsum(codes[data] * up[: len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(_U) * _MIX1)


#: Longer words are named by a cryptographic hash: modulo 2^64 long strings can be built that collide for every base.
LONG_WORD = 256


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray, fold: bool = False) -> np.ndarray:
    """A 64-bit hash of each word of a buffer; with fold A-Z count as a-z, as they must in codes."""
    out = RangeHash(data, codes)(starts, ends)
    for i in np.flatnonzero(ends - starts > LONG_WORD):
        own = data[starts[i] : ends[i]].tobytes()
        own = own.translate(_FOLDED) if fold else own
        out[i] = int.from_bytes(hashlib.blake2b(own, digest_size=8, key=int(codes[0]).to_bytes(8, "little")).digest(), "little")
    return out


_FOLDED = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return flat[at[0] : at[-1]], at - at[0]


def steps(offsets: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes each; every row is in one."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a step, and where each row's words begin in them (one more entry than rows)."""
    if not len(data):
        none = np.empty(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~WHITE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) & ~edge[:-1]
    after = np.concatenate([inside[1:], [False]]) & ~edge[1:]
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow; at a task's end memory that its worker no longer uses goes back to the system, as workers are kept."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return own


def release() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def batch(columns: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
