"""Best-fit packing of tokenised documents into sequences, certified by lower bounds.

Each partition packs its pieces by best-fit decreasing and certifies its bin count with dual-feasible-function bounds.
Partitions whose count is above their bound give up their loosest bins; these documents are exchanged, a few partitions'
worth to each new one, and packed again, until the last exchange is a single small partition or nothing is left to gain.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, releasing, steps, utf8

#: Tokens of a sequence, and the id that ends a document.
TOKENS, END = 4096, 1
#: Pieces that one partition packs at first.
PIECES = 50_000
#: Bytes of text that are split into words at once.
STEP = 5 << 20
#: Words that the tokenizer doesn't normalise, and their runs: letters, one digit, or symbols. It parts some words at an apostrophe, too.
_LETTERS, _SYMBOLS = "a-zß-öø-ÿ", r"!-&(-/:-@\[-`{-~"
PLAIN, RUN = f"^[{_LETTERS}0-9{_SYMBOLS}]+$", f"([{_LETTERS}]+|[0-9]|[{_SYMBOLS}]+)"

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def vocabulary() -> str:
    """The default tokenizer file; its place is a parameter of the operators."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Token ids of words. Tokens never span white space, so a text's ids are those of its words, one after the other.

    A word of lower-case Latin letters, digits and ASCII symbols without an apostrophe needs no normalising, and is parted into
    runs as the tokenizer parts it; the distinct runs are encoded by its model alone. Any other word is encoded by the whole
    tokenizer. The distinct words of a step are encoded once; nothing is kept from step to step.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        #: These are found in a text as it is, before it is lower-cased.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        for token, i in vocabulary.items():
            self.last[i] = token.endswith("</w>")

    def with_added(self, texts: pa.Array) -> pa.Array:
        """Which texts hold one of the added tokens."""
        return functools.reduce(pc.or_, [pc.match_substring(texts, t) for t in self.added], pa.array(np.zeros(len(texts), dtype=bool)))

    def lower(self, texts: pa.Array) -> pa.Array:
        """texts with A-Z as a-z, as the tokenizer does itself, but for those that would hold an added token then."""
        lower = pc.ascii_lower(texts)
        return pc.if_else(self.with_added(lower), texts, lower)

    def _alone(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, all in a row, and how many each has."""
        ids, sizes = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for i in range(0, len(words), 5000):
            each = [e.ids for e in self.tokenizer.encode_batch_fast(words.slice(i, 5000).to_pylist(), add_special_tokens=False)]
            ids.append(np.array([x for e in each for x in e], np.uint32))
            sizes.append(np.array(list(map(len, each)), np.int64))
        return np.concatenate(ids), np.concatenate(sizes)

    def _runs(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for runs: many at once, split after the ids that end a run."""
        ids, sizes = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        at = np.append(np.arange(0, len(runs), 1000), len(runs))
        for i, joined in enumerate(pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), runs), " ")):
            own = runs.slice(at[i], 1000)
            got = np.array(self.model.encode_batch_fast([joined.as_py()], add_special_tokens=False)[0].ids, np.uint32)
            size = np.diff(np.flatnonzero(self.last[got]) + 1, prepend=0)
            if len(size) != len(own) or size.sum() != len(got):
                got, size = self._alone(own)
            ids.append(got)
            sizes.append(size)
        return np.concatenate(ids), np.concatenate(sizes)

    def __call__(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each distinct word's entry; the entries' ids, all in a row; and how many each has."""
        plain = pc.and_not(pc.match_substring_regex(words, PLAIN), self.with_added(words))
        split = pc.ascii_split_whitespace(pc.ascii_rtrim_whitespace(pc.replace_substring_regex(words.filter(plain), RUN, r"\1 ")))
        runs = pc.dictionary_encode(split.flatten())
        code, at = runs.indices.to_numpy(zero_copy_only=False), split.offsets.to_numpy().astype(np.int64)
        ids, sizes = self._runs(runs.dictionary)
        before = np.concatenate([[0], np.cumsum(sizes[code])])
        ids, rest = _gather(ids, sizes, code), self._alone(words.filter(pc.invert(plain)))
        entry = np.argsort(np.argsort(~plain.to_numpy(zero_copy_only=False), kind="stable"), kind="stable")
        return entry, np.concatenate([ids, rest[0]]), np.concatenate([np.diff(before[at - at[0]]), rest[1]])


def _gather(ids: np.ndarray, sizes: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """The ids of these entries, one after the other."""
    begin, size = (np.cumsum(sizes) - sizes)[entry], sizes[entry]
    end = np.cumsum(size)
    return ids[np.arange(int(end[-1]) if len(end) else 0) + np.repeat(begin - end + size, size)]


def _ids(texts: pa.Array, words: WordIds) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all texts in a row, each text's last id END, and where each text's ids begin."""
    split = pc.ascii_split_whitespace(words.lower(texts))
    at = split.offsets.to_numpy().astype(np.int64)
    flat = pc.dictionary_encode(split.values.slice(int(at[0]), int(at[-1] - at[0])))
    at -= at[0]
    entry, ids, sizes = words(flat.dictionary)
    entry = np.insert(entry[flat.indices.to_numpy(zero_copy_only=False)], at[1:], len(sizes))
    ids, sizes = np.append(ids, np.uint32(END)), np.append(sizes, 1)
    first = np.concatenate([[0], np.cumsum(sizes[entry])])[at + np.arange(len(at))]
    return _gather(ids, sizes, entry), first


def pieces(docs: DataFrame, path: str | None = None, tokens: int = TOKENS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece of docs(doc_id, text); null texts are empty: one END."""
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(path)  # for this task; a kept one would stay in idle workers
        for rows in batches:
            text = pc.fill_null(rows.column("text"), "")
            doc_id = rows.column("doc_id").to_pylist()
            for lo, hi in steps(utf8(text)[1], STEP):
                ids, first = _ids(text.slice(lo, hi - lo), words)
                out = []
                raw = ids.astype("<u4").tobytes()
                for i in range(hi - lo):
                    for piece, start in enumerate(range(int(first[i]), int(first[i + 1]), tokens)):
                        end = min(start + tokens, int(first[i + 1]))
                        out.append((doc_id[lo + i], piece, start - int(first[i]), end - start, zlib.crc32(raw[4 * start : 4 * end])))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(releasing(run), PIECE_SCHEMA)


def lower_bound(lengths: np.ndarray, tokens: int = TOKENS) -> int:
    """Bins that any packing needs: the best of the volume bound and two families of dual feasible functions."""
    if not len(lengths):
        return 0
    size, count = np.unique(lengths, return_counts=True)
    best = -(-int((size * count).sum()) // tokens)
    for cut in np.unique(np.minimum(size, tokens - size)[np.minimum(size, tokens - size) <= tokens // 2]):
        # pieces over tokens - cut fill a bin, those below cut count nothing
        value = np.where(size > tokens - cut, tokens, np.where(size >= cut, size, 0))
        best = max(best, -(-int((value * count).sum()) // tokens))
    for k in range(1, 33):  # rounding to k-ths: exact multiples of tokens / (k + 1) keep their size
        scaled = size * (k + 1)
        value = np.where(scaled % tokens == 0, size * k, scaled // tokens * tokens)
        best = max(best, -(-int((value * count).sum()) // (tokens * k)))
    return best


def best_fit(lengths: np.ndarray, tokens: int = TOKENS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: bin and offset of each piece, and the fill of each bin. Room is looked up by bit tricks on
    one integer that has a bit for each amount of room that some bin has."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    fill: list[int] = []
    open_: list[list[int]] = [[] for _ in range(tokens + 1)]
    rooms = 0
    for i in order.tolist():
        n = int(lengths[i])
        fits = rooms >> n
        if fits:
            room = n + ((fits & -fits).bit_length() - 1)
            b = open_[room].pop()
            if not open_[room]:
                rooms &= ~(1 << room)
        else:
            b, room = len(fill), tokens
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        if room > n:
            open_[room - n].append(b)
            rooms |= 1 << (room - n)
    return bins, offsets, np.array(fill, np.int64)


_PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, open boolean"


def _pack(tokens: int, level: int, final: bool):
    """Packs one partition; bins over the certified bound's mean fill stay, the loosest others are given up."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], kind="stable").reset_index(drop=True)
        lengths = pdf["length"].to_numpy()
        bins, offsets, fill = best_fit(lengths, tokens)
        given = np.zeros(len(fill), dtype=bool)
        if not final and len(fill) > lower_bound(lengths, tokens):
            loose = np.argsort(fill, kind="stable")
            loose = loose[fill[loose] < tokens]
            # the loosest quarter of the bins with room, at least two
            given[loose[: max(2, len(loose) // 4)]] = True
        elif not final:  # at its bound: only the last, loosest bin may still take pieces of others
            given[np.argmin(fill)] = fill.min() < tokens
        return pdf.assign(sequence_id=(np.int64(level) << 56) | (np.int64(key[0]) << 28) | bins, offset=offsets, open=given[bins])[[c.split()[0] for c in _PACKED.split(", ")]]

    return run


def pack(found: DataFrame, tokens: int = TOKENS) -> DataFrame:
    """found(doc_id, piece, start, length, ids_crc32) with sequence_id and offset. Full pieces are sequences of their own.

    Which partition packs a piece follows from its id, so a lost task is repeated alike. Full pieces are numbered by row, as
    equal ones of repeated rows need a sequence each; the numbers are stored.
    """
    found = materialise(found)
    full = materialise(found.where(f"length = {tokens}").withColumn("sequence_id", F.expr("monotonically_increasing_id() | shiftleft(1L, 63)")).withColumn("offset", F.lit(0).cast("long")))
    left = found.where(f"length < {tokens}")
    n, level, done = left.count(), 0, None
    while True:
        parts = max(1, -(-n // PIECES))
        key = F.expr(f"cast(pmod(xxhash64(doc_id, piece, start, ids_crc32, {level}), {parts}) as long)")
        packed = materialise(left.withColumn("part", key).groupBy("part").applyInPandas(_pack(tokens, level, parts == 1), _PACKED))
        closed = packed.where("not open").drop("open")
        done = closed if done is None else done.unionByName(closed)
        if parts == 1:
            break
        left = packed.where("open").select("doc_id", "piece", "start", "length", "ids_crc32")
        last, n, level = n, left.count(), level + 1
        if not n:
            break
        if n > 0.9 * last:  # nothing left to gain by an exchange: every bin is closed as it is
            done = done.unionByName(packed.where("open").drop("open"))
            break
    return full.unionByName(done)


def digest(docs: DataFrame, path: str | None = None, tokens: int = TOKENS) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are the END id alone; repeated rows are packed each; extra columns are ignored; an empty table
    gives an empty result.
    """
    return pack(pieces(docs, path, tokens), tokens)
