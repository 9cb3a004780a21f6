"""SentencePiece encoding and decoding by a batched numpy Viterbi.

For a BPE model the pieces of a text are those of its words, and a sequence of pieces is the model's own if and only if each
two neighbours are: merging both from characters gives them back. So the last piece of each prefix of a word follows from
the last pieces of shorter prefixes. Words of equal length advance together, a character at a time: hashes of the
substrings that end there probe the sorted piece keys, pairs that aren't the model's own score minus infinity, and the
vectorised maximum stores the back pointer. A word whose pieces don't spell it (two substrings of one hash), or one too
long to share its length with others, takes the same recurrence with the pieces' texts as keys.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, mix, powers, releasing, steps, utf8

SPACE = "▁"
#: Bytes of text that are coded at once; words that advance together; characters beyond which a word goes by itself.
STEP, ROWS, LONG = 16 << 20, 16_384, 256
#: Bits of the directory of the sorted keys, and of the slots that keep verdicts on pairs.
DIRECTORY, PAIR_SLOTS = 18, 22

_U = np.uint64
_STRAY = re.compile("[\udc80-\udcff]")


def vocabulary() -> str:
    """The default model file; its place is a parameter of the operators."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _hashes(codes: np.ndarray):
    """For rows of code points: a function (start, end) that gives the hash of that range of each row."""
    up, down = powers(codes.shape[1] + 1)
    sums = np.zeros((codes.shape[1] + 1, len(codes)), _U)
    np.cumsum((mix(codes + _U(1)) * up[: codes.shape[1]]).T, axis=0, out=sums[1:])
    return lambda start, end: mix((sums[end] - sums[start]) * down[start] + _U(end - start))


def _codes(texts: list[str]) -> np.ndarray:
    """Code points of texts of equal length, a row each."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(texts), -1)


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places begin[0], ..., begin[0] + size[0] - 1, begin[1], ..."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - (ends - size), size)


class Pieces:
    """A BPE model's pieces as sorted keys, with the merges that make them."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.text = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.ids = {self.text[i]: i for i in plain}
        score = np.array([model.get_score(i) for i in range(n)])
        made = [i for i in plain if len(self.text[i]) > 1]
        runs = [i for i in made if not self.text[i].strip(SPACE)]
        if (score[made] != np.round(score[made])).any() or len(np.unique(score[made])) < len(set(made) - set(runs)):
            raise ValueError("not a BPE model: its scores aren't the order of its merges")
        if any(SPACE in p.lstrip(SPACE) or (p.startswith(SPACE * 2) and p.strip(SPACE)) for p in self.ids):
            raise ValueError("pieces with white space inside or after more white space aren't supported")
        if runs and score[runs].max() > score[[i for i in made if self.text[i].strip(SPACE)]].min():
            raise ValueError("white space must merge last")
        #: Bytes that stand for an unknown character, and the bytes that ids stand for.
        self.byte = np.zeros(256, np.int32)
        raw = [b""] * (n + 1)
        for i in plain:
            raw[i] = self.text[i].replace(SPACE, " ").encode()
        for i in range(n):
            if model.is_byte(i):
                self.byte[int(self.text[i][1:-1], 16)] = i
                raw[i] = bytes([int(self.text[i][1:-1], 16)])
        if (self.byte == 0).any():
            raise ValueError("a model without pieces of bytes isn't supported")
        self.is_byte = np.array([model.is_byte(i) for i in range(n)] + [False])
        self.raw, self.raw_size = np.frombuffer(b"".join(raw), np.uint8), np.array(list(map(len, raw)), np.int64)
        self.raw_begin = np.cumsum(self.raw_size) - self.raw_size
        #: A smaller rank merges earlier, of equal ones (white space) the leftmost; single characters have -1. The id after the last stands for unknown characters.
        self.rank = np.full(n + 1, -1, np.int64)
        self.rank[made] = np.searchsorted(np.unique(-score[made]), -score[made])
        self.unknown, self.longest = n, max(map(len, self.ids))
        #: Characters of each piece, and how many it has.
        self.size = np.array([len(t) for t in self.text] + [1])
        self.chars = np.zeros((n + 1, self.longest), np.uint32)
        for i in plain:
            self.chars[i, : self.size[i]] = [ord(c) for c in self.text[i]]
        self.left, self.right = np.full(n + 1, -1, np.int64), np.full(n + 1, -1, np.int64)
        self._merges(made)
        stable = np.array([i for i in plain if len(self.text[i]) == 1 or self.left[i] >= 0], np.int64)
        self.stable = {self.text[i]: i for i in stable.tolist()}
        keys = np.empty(len(stable), _U)
        length = np.array([len(self.text[i]) for i in stable])
        for size in np.unique(length).tolist():
            own = np.flatnonzero(length == size)
            keys[own] = _hashes(_codes([self.text[i] for i in stable[own]]).astype(_U))(0, size)
        order = np.argsort(keys)
        self.keys, self.key_ids = keys[order], stable[order]
        # where the keys with given first bits begin: a probe looks at the few keys from there on
        self.bucket = np.append(np.searchsorted(self.keys, np.arange(1 << DIRECTORY, dtype=_U) << _U(64 - DIRECTORY)), len(self.keys)).astype(np.int32)
        self.deepest = int(np.diff(self.bucket).max())
        self.keys, self.key_ids = np.append(self.keys, np.zeros(self.deepest, _U)), np.append(self.key_ids, np.full(self.deepest, -1))
        # verdicts on pairs, the latest in each slot
        self.pair_seen, self.pair_good = np.full(1 << PAIR_SLOTS, -1, np.int64), np.zeros(1 << PAIR_SLOTS, dtype=bool)

    def _merges(self, made: list[int]) -> None:
        """Finds each piece's last merge, shorter pieces first. Pieces that merging never makes have none."""
        pairs, by_length = [], {}
        for i in made:
            p = self.text[i]
            by_length.setdefault(len(p), []).append(len(pairs))
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None:
                    pairs.append((a, b, i))
        a, b, whole = np.array(pairs, np.int64).reshape(-1, 3).T
        key = a * (self.unknown + 1) + b
        order = np.argsort(key)
        self.pair_key, self.pair_rank = key[order], self.rank[whole[order]]
        size = self.size[whole]
        for length in sorted(by_length):
            own = np.flatnonzero(size == length)
            x, y, p = a[own], b[own], whole[own]
            good = ((self.rank[x] < 0) | (self.left[x] >= 0)) & ((self.rank[y] < 0) | (self.left[y] >= 0))
            x, y, p = x[good], y[good], p[good]
            good = self._own_pairs(x, y, 2 * self.rank[p])
            self.left[p[good]], self.right[p[good]] = x[good], y[good]

    def _own_pairs(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether merging the text of both from characters gives a and b, up to the merge `limit` (twice its rank): no pair
        across them merges before its parts go."""
        x, y, limit = a.copy(), b.copy(), np.full(len(a), np.iinfo(np.int64).max) if limit is None else limit.copy()
        good, live = np.ones(len(a), dtype=bool), np.flatnonzero((a != self.unknown) & (b != self.unknown))
        while len(live):
            key = x[live] * (self.unknown + 1) + y[live]
            at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
            bad = (self.pair_key[at] == key) & (2 * self.pair_rank[at] < limit[live])
            good[live[bad]] = False
            live = live[~bad]
            live = live[(self.left[x[live]] >= 0) | (self.left[y[live]] >= 0)]
            first = self.rank[x[live]] > self.rank[y[live]]
            f, s = live[first], live[~first]
            limit[f], limit[s] = 2 * self.rank[x[f]], 2 * self.rank[y[s]] + 1
            x[f], y[s] = self.right[x[f]], self.left[y[s]]
        return good

    def own_pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """_own_pairs, with the verdicts on frequent pairs kept."""
        key = a * (self.unknown + 1) + b
        slot = ((key.astype(_U) * _U(0x9E3779B97F4A7C15)) >> _U(64 - PAIR_SLOTS)).astype(np.int64)
        good = self.pair_good[slot]
        new = np.flatnonzero(self.pair_seen[slot] != key)
        if len(new):
            more, back = np.unique(key[new], return_inverse=True)
            found = self._own_pairs(more // (self.unknown + 1), more % (self.unknown + 1))
            good[new] = found[back]
            self.pair_seen[slot[new]] = key[new]
            self.pair_good[slot[new]] = good[new]
            # of two pairs in one slot the last stays; its verdict was written last, too
        return good

    def probe(self, key: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these hashes, -1 for none."""
        at = self.bucket[(key >> _U(64 - DIRECTORY)).astype(np.int64)]
        out = np.where(self.keys[at] == key, self.key_ids[at], -1)
        for i in range(1, self.deepest):
            hit = self.keys[at + i] == key
            if hit.any():
                out = np.where(hit, self.key_ids[at + i], out)
        return out

    def viterbi(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces of words of equal length, given as rows of code points: all ids in a row, how many each word has, and the
        words that their pieces don't spell. An unknown character c has the id unknown + 1 + c."""
        rows, n = codes.shape
        hashed = _hashes(codes.astype(_U))
        last = np.full((n + 1, rows), -1, np.int64)
        back = np.zeros((n + 1, rows), np.int64)
        for end in range(1, n + 1):
            best = back[end]  # the longest piece wins; of those that are the model's own there is one
            for length in range(1, min(self.longest, end) + 1):
                piece = self.probe(hashed(end - length, end))
                if length == 1:
                    piece[piece < 0] = self.unknown
                some = np.flatnonzero(piece >= 0)
                if end > length and len(some):
                    before = last[end - length, some]
                    some = some[before >= 0]
                    some = some[self.own_pairs(last[end - length, some], piece[some])]
                best[some], last[end, some] = length, piece[some]
        # all words step back together
        row, at = np.arange(rows), np.full(rows, n)
        found, of, start, step = [], [], [], []
        while len(row):
            found.append(last[at, row])
            of.append(row)
            step.append(np.maximum(back[at, row], 1))
            at = at - step[-1]
            start.append(at)
            row, at = row[at > 0], at[at > 0]
        ids, of, start, step = (np.concatenate(x[::-1]) for x in (found, of, start, step))
        spelt = (ids >= 0) & (self.size[ids] == step)
        for i in range(int(step.max(initial=0))):
            spelt &= (i >= step) | (self.chars[ids, min(i, self.longest - 1)] == codes[of, np.minimum(start + i, n - 1)]) | (ids == self.unknown)
        ids = np.where(ids == self.unknown, self.unknown + 1 + codes[of, start].astype(np.int64), ids)
        order = np.argsort(of, kind="stable")
        return ids[order], np.bincount(of, minlength=rows), np.unique(of[~spelt])

    def one(self, word: str) -> list[int]:
        """viterbi() of a single word, with the pieces' texts as keys."""
        last, back, seen = [-1] * (len(word) + 1), [0] * (len(word) + 1), {}
        for end in range(1, len(word) + 1):
            for length in range(1, min(self.longest, end) + 1):
                piece = self.stable.get(word[end - length : end], self.unknown if length == 1 else -1)
                if piece < 0:
                    continue
                if end > length:
                    pair = (last[end - length], piece)
                    if pair not in seen:
                        if len(seen) > 1 << 18:
                            seen.clear()
                        seen[pair] = pair[0] >= 0 and bool(self._own_pairs(np.array(pair[:1]), np.array(pair[1:]))[0])
                    if not seen[pair]:
                        continue
                last[end], back[end] = piece, length
        out, at = [], len(word)
        while at > 0:
            out.append(last[at] if last[at] != self.unknown else self.unknown + 1 + ord(word[at - 1]))
            at -= back[at]
        return out[::-1]

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces of distinct words, which start with SPACE, or are made of it: ids, and where each word's begin and how many
        they are. Unknown characters have the pieces of their bytes."""
        data, at = utf8(words)
        codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        first = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[at]
        length = np.diff(first)
        order = np.argsort(length, kind="stable")
        found, total, begin, size = [np.empty(0, np.int64)], 0, np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)

        def keep(own: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
            nonlocal total
            size[own], begin[own] = sizes, total + np.cumsum(sizes) - sizes
            found.append(ids)
            total += len(ids)

        alone = [np.flatnonzero(length > LONG)]
        for n in range(1, LONG + 1):
            lo, hi = np.searchsorted(length, [n, n + 1], sorter=order)
            for i in range(lo, hi, ROWS):
                own = order[i : min(i + ROWS, hi)]
                ids, sizes, wrong = self.viterbi(codes[first[own][:, None] + np.arange(n)])
                keep(own, ids, sizes)
                alone.append(own[wrong])
        for i in np.concatenate(alone).tolist():
            ids = np.array(self.one(codes[first[i] : first[i + 1]].tobytes().decode("utf-32-le")), np.int64)
            keep(np.array([i]), ids, np.array([len(ids)]))
        flat = np.concatenate(found)
        strange = np.flatnonzero(flat > self.unknown)
        if len(strange):  # ids make room for the bytes of unknown characters
            char = flat[strange] - self.unknown - 1
            spread = np.ones(len(flat), np.int64)
            spread[strange] = 1 + (char > 0x7F) + (char > 0x7FF) + (char > 0xFFFF)
            ends = np.concatenate([[0], np.cumsum(spread)])
            flat = np.repeat(flat, spread)
            flat[flat > self.unknown] = self.byte[np.frombuffer(char.astype(np.uint32).tobytes().decode("utf-32-le").encode(), np.uint8)]
            begin, size = ends[begin], ends[begin + size] - ends[begin]
        return flat.astype(np.int32), begin, size

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's begin. An empty text has none."""
        split = pc.split_pattern(pc.replace_substring(texts, SPACE, " "), " ")
        at = split.offsets.to_numpy().astype(np.int64)
        parts = pc.dictionary_encode(split.values.slice(int(at[0]), int(at[-1] - at[0])))
        at -= at[0]
        code = parts.indices.to_numpy(zero_copy_only=False)
        filled = pc.binary_length(parts.dictionary).to_numpy(zero_copy_only=False) > 0
        flat, begin, size = self.words(pc.binary_join_element_wise(SPACE, parts.dictionary, ""))
        alone = flat[np.minimum(begin, len(flat) - 1)] == self.ids.get(SPACE, -1) if len(flat) else filled
        full = filled[code]
        # each part of a text has one SPACE before it; empty parts and a SPACE that its word leaves form runs
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))
        start = np.ones(len(code), dtype=bool)
        start[1:] = full[:-1] | (row[1:] != row[:-1])
        group = np.cumsum(start) - 1
        run = np.bincount(group, weights=~full, minlength=group[-1] + 1 if len(group) else 0).astype(np.int64)
        final = np.ones(len(code), dtype=bool)
        final[:-1] = start[1:]
        final = np.flatnonzero(final)  # the word that ends a group, or the last SPACE of a run at the end of a text
        word = full[final]
        empty = (np.diff(at) == 1) & (pc.binary_length(texts).to_numpy(zero_copy_only=False) == 0)
        run[empty[row[final]]] = 0
        joins = word & alone[code[final]] & (run > 0)  # the word's first piece is SPACE: it belongs to the run
        run = run + joins
        lengths, which = np.unique(run, return_inverse=True)
        run_flat, run_begin, run_size = self.words(pa.array([SPACE * n for n in lengths.tolist()], pa.string()))
        own = code[final]
        begins, sizes = np.empty(2 * len(final), np.int64), np.empty(2 * len(final), np.int64)
        begins[0::2], sizes[0::2] = len(flat) + run_begin[which], run_size[which]
        begins[1::2], sizes[1::2] = begin[own] + joins, np.where(word, size[own] - joins, 0)
        ids = np.concatenate([flat, run_flat])[_ranges(begins, sizes)]
        return ids, np.concatenate([[0], np.cumsum(sizes)])[2 * np.searchsorted(final, at)]

    def decode(self, ids: np.ndarray, first: np.ndarray) -> pa.Array:
        """The texts of ids(first[0] : first[1]), ...; each byte that isn't UTF-8 becomes U+FFFD, and the first SPACE goes."""
        size = self.raw_size[ids]
        data = self.raw[_ranges(self.raw_begin[ids], size)]
        at = np.concatenate([[0], np.cumsum(size)])[first]
        spaced = np.flatnonzero(at[:-1] < at[1:])
        spaced = spaced[data[at[spaced]] == 32]
        data = np.delete(data, at[spaced])
        at = at - np.concatenate([[0], np.cumsum(np.bincount(spaced, minlength=len(at) - 1))])
        out = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)])
        odd = np.add.reduceat(np.append(self.is_byte[ids], False), np.minimum(first[:-1], len(ids))) if len(first) > 1 else np.zeros(0)
        if not odd[first[:-1] < first[1:]].any():  # whole pieces are UTF-8
            return out.view(pa.large_string()).cast(pa.string())
        return pa.array([_STRAY.sub("\ufffd", b.decode("utf-8", "surrogateescape")) for b in out.to_pylist()], pa.string())


@lru_cache(maxsize=1)
def pieces(path: str) -> Pieces:
    """One for each worker; its size is that of the model."""
    return Pieces(path)


def _coded(text: pa.Array, model: Pieces) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For steps of rows of text: the rows' range, ids, where each row's begin, and which are null."""
    filled, null = pc.fill_null(text, ""), text.is_null().to_numpy(zero_copy_only=False)
    for lo, hi in steps(utf8(filled)[1], STEP):
        yield lo, hi, *model.encode(filled.slice(lo, hi - lo)), null[lo:hi]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text, ids) of docs; a null text has null ids, an empty one none."""
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for lo, hi, ids, first, null in _coded(rows.column("text"), pieces(path)):
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32), mask=np.append(null, False)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id").slice(lo, hi - lo), rows.column("text").slice(lo, hi - lo), lists], names=["doc_id", "text", "ids"])

    return _texts(docs).mapInArrow(releasing(run), "doc_id long, text string, ids array<int>")


def decode(coded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, decoded) of coded(doc_id, ids); null ids give a null text."""
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            lists = rows.column("ids")
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            for lo, hi in steps(first, STEP // 4):
                ids = pc.list_flatten(lists.slice(lo, hi - lo)).to_numpy(zero_copy_only=False)
                text = pieces(path).decode(ids, first[lo : hi + 1] - first[lo])
                yield pa.RecordBatch.from_arrays([rows.column("doc_id").slice(lo, hi - lo), pc.if_else(lists.slice(lo, hi - lo).is_null(), pa.scalar(None, pa.string()), text)], names=["doc_id", "decoded"])

    return coded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(releasing(run), "doc_id long, decoded string")


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per row: doc_id, n_ids, ids_crc32, round_trip (the decoded ids are the text, U+2581 taken as a blank; null equals null).

    Texts are encoded and decoded in one pass. ids_crc32 is of unsigned 32-bit ids. Repeated rows are coded each; extra
    columns are ignored; an empty table gives an empty result.
    """
    path = path or vocabulary()
    schema = pa.schema([("doc_id", pa.int64()), ("n_ids", pa.int64()), ("ids_crc32", pa.int64()), ("round_trip", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for rows in batches:
            for lo, hi, ids, first, null in _coded(rows.column("text"), model):
                same = pc.equal(model.decode(ids, first), pc.replace_substring(pc.fill_null(rows.column("text").slice(lo, hi - lo), ""), SPACE, " "))
                raw, ends = ids.astype("<u4").tobytes(), first.tolist()
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield batch({"doc_id": rows.column("doc_id").slice(lo, hi - lo), "n_ids": np.diff(first), "ids_crc32": crc, "round_trip": pc.or_(same, pa.array(null))}, schema)

    return _texts(docs).mapInArrow(releasing(run), "doc_id long, n_ids long, ids_crc32 long, round_trip boolean")
