"""Substring dedup, the conversation trie and vector codes against plain versions, and on odd tables."""

import hashlib
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tripwatch.llm import conversation_trie, substring_dedup, vector_codes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, row string, runs string, _row string"
TURNS = "conv_id long, turn long, role string, text string, path string, name string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- substring dedup
def plain_substring(rows, width=13):
    docs = [(math.inf if d is None else d, WORD.findall(t or "")) for d, t in rows]
    least = defaultdict(lambda: math.inf)
    for d, w in docs:
        for i in range(len(w) - width + 1):
            key = tuple(w[i : i + width])
            least[key] = min(least[key], d)
    out = []
    for (d, w), (real, _) in zip(docs, rows, strict=True):
        gone = set()
        for i in range(len(w) - width + 1):
            if least[tuple(w[i : i + width])] < d:
                gone.update(range(i, i + width))
        out.append((real, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return sorted(out, key=str)


def passages():
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(40)] + ["é", "日本", "x" * 300, "y" * 300]
    text = lambda n: " ".join(rng.choice(vocab, n))
    shared = [text(n) for n in (13, 14, 40, 200)]
    rows = [(int(i), f"{text(rng.integers(0, 30))}\n{shared[rng.integers(4)]} \t{text(rng.integers(0, 30))}") for i in range(60)]
    rows += [(5, rows[0][1]), (None, shared[3]), (None, shared[2]), (7, None), (8, ""), (9, "   "), (3, "a b c"), (3, "a b c"), (100, shared[0]), (101, shared[0] + " " + shared[0]), (102, shared[0].replace(" ", "\r\n"))]
    return rows


@pytest.mark.parametrize("slice_cells", [1 << 29, 1 << 18])
def test_substring_dedup_equals_plain(spark, monkeypatch, slice_cells):
    monkeypatch.setattr(substring_dedup, "SLICE", slice_cells)
    rows = passages()
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], DOCS)
    assert sorted(map(tuple, substring_dedup.digest(df).collect()), key=str) == plain_substring(rows)


def test_substring_dedup_full_sketch_loses_none(spark, monkeypatch):
    """A sketch of far too few cells passes every window, and the result is the same."""
    monkeypatch.setattr(substring_dedup, "CELLS_PER_BYTE", 1e-9)
    rows = passages()
    assert sorted(map(tuple, substring_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str) == plain_substring(rows)


def test_substring_dedup_texts(spark):
    part = " ".join(f"p{i}" for i in range(20))
    df = spark.createDataFrame([(1, part, "a"), (2, f"head {part} tail", "b"), (3, None, "c")], "doc_id long, text string, runs string")
    out = substring_dedup.deduplicate(df)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect())) == [(1, part, "a"), (2, "head tail", "b"), (3, None, "c")]


def test_substring_dedup_long_text(spark):
    """A text of 20 MB whose first half is another document's."""
    half = " ".join(f"{i:x}" for i in range(1_400_000))
    other = " ".join(f"{i:x}z" for i in range(1_300_000))
    got = {r.doc_id: r for r in substring_dedup.digest(spark.createDataFrame([(1, half), (2, f"{half} {other}")], "doc_id long, text string")).collect()}
    assert len(half) + len(other) > 17_000_000
    assert (got[1].n_removed, got[2].n_removed, got[2].kept_sha256) == (0, 1_400_000, sha(other))


# --- conversation trie
def plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest(), role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(x)] for c, x in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        path = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    kids = defaultdict(list)
    for path in members:
        if path:
            kids[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        words = len(WORD.findall(path[-1][1])) if path else 0
        leaves[path] = sum(leaves[k] for k in kids[path]) or 1
        saved[path] = (len(members[path]) - 1) * words + sum(saved[k] for k in kids[path])
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], sha(",".join(map(str, sorted(ends[p]))))) for p, m in members.items()), key=str)


def talks():
    rng = np.random.default_rng(5)
    rows = []
    for c in range(400):
        for t in range(rng.integers(0, 7)):
            rows.append((c, t if rng.random() > 0.05 else None, ["user", "assistant", None][rng.integers(3)], ["hello there", "yes", "", None, "a b\tc"][rng.integers(5)]))
    rows += [(20_000 + i, t, "user", "same words here") for i in range(300) for t in range(3)] + [(None, 1, "user", "nobody's"), (7, 0, "user", "hello there"), (7, 0, "user", "hello there")]
    rows += [(20_400, t, "user", f"long {t}") for t in range(500)] + [(21_000, t, "user", f"long {t}") for t in range(499)]
    return rows


@pytest.mark.parametrize("shard", [1 << 18, 64, 700])
def test_trie_equals_plain(spark, shard):
    rows = talks()
    df = spark.createDataFrame([(*r, "a", "b") for r in rows], TURNS)
    assert sorted(map(tuple, conversation_trie.digest(df, shard).collect()), key=str) == plain_trie(rows)


def test_trie_many_members_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "PIECE_BITS", 3)
    rows = [(c, 0, "user", "one") for c in range(40, 140)]
    assert sorted(map(tuple, conversation_trie.digest(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()), key=str) == plain_trie(rows)


def test_parentheses_close():
    rng = np.random.default_rng(1)
    for n in (1, 5, 40, 700, 5000):
        bits, open_, stack, close = [], 0, [], {}
        for _ in range(2 * n):
            up = open_ < n and (not stack or rng.random() < (0.55 if n < 700 else 0.8))
            if up:
                stack.append(len(bits))
                open_ += 1
            elif stack:
                close[stack.pop()] = len(bits)
            bits.append(up)
        opens = np.flatnonzero(bits)
        assert conversation_trie.Parentheses(np.array(bits)).close(opens).tolist() == [close[i] for i in opens]


# --- vector codes
def plain_codes(rows, rounds=6, entries=16):
    kept = [(v, [math.floor(4096 * float(np.float32(x))) for x in e], lab) for v, e, lab in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    width = max(1, -(-max((len(x) for _, x, _ in kept), default=1) // 8))
    kept = [(v, x + [0] * (8 * width - len(x)), lab) for v, x, lab in kept]
    part = lambda x, p: x[p * width : (p + 1) * width]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[part(x, p) for _, x, _ in first] for p in range(8)]
    far = lambda a, b: sum((i - j) ** 2 for i, j in zip(a, b, strict=True))
    nearest = lambda x, p: min((far(part(x, p), e), j) for j, e in enumerate(books[p]))
    for _ in range(rounds):
        got = [[nearest(x, p)[1] for p in range(8)] for _, x, _ in kept]
        for p in range(8):
            for j in range(len(books[p])):
                own = [part(x, p) for (_, x, _), g in zip(kept, got, strict=True) if g[p] == j]
                if own:
                    books[p][j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out, labels = [], defaultdict(int)
    for v, x, lab in kept:
        best = [nearest(x, p) for p in range(8)]
        out.append((v, "".join(f"{j:02x}" for _, j in best), sum(d for d, _ in best), lab))
        labels[lab] += out[-1][2]
    name = sha(",".join(str(c) for b in books for e in b for c in e))
    return sorted(((v, code, err, labels[lab], name) for v, code, err, lab in out), key=str)


def vectors(n=400, size=64, seed=2):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(9, size))
    rows = [(int(i), (centers[rng.integers(9)] + rng.normal(size=size) * 0.3).astype(np.float32).tolist(), int(rng.integers(3)) if rng.random() > 0.1 else None) for i in rng.permutation(n)]
    return rows


def odd():
    rows = vectors(60, 16)
    return [*rows, *rows[:25], (1, rows[3][1], 2), (None, rows[4][1], None), (70, None, 1), (71, [float("nan")] * 16, 1), (72, [float("inf")] + [0.0] * 15, 1), (73, [None] + [0.0] * 15, 1), (74, [0.5, -0.25], 1), (75, [], None), *[(80 + i, [0.0] * 16, 0) for i in range(30)]]


@pytest.mark.parametrize("rows", [vectors(), vectors(300, 8, 4), odd(), vectors(5, 24), [(1, [0.5] * 8, None)]])
def test_vector_codes_equal_plain(spark, rows):
    df = spark.createDataFrame([(v, lab, e, "x", "y") for v, e, lab in rows], "vec_id long, label int, embedding array<float>, code string, x string")
    assert sorted(map(tuple, vector_codes.digest(df).collect()), key=str) == plain_codes(rows)


def test_vector_bounds_skip_distances(spark):
    """The bounds leave most parts without any distance in a later round, and b falls."""
    rng = np.random.default_rng(9)
    x = (rng.normal(size=(5000, 8)) * 1000).astype(np.int64)
    book = x[:16].copy()
    own = vector_codes.Bounds.empty(len(x), 4)
    own.search(np.arange(len(x)), x, book)
    for _ in range(6):
        new = np.array([x[own.own == j].sum(0) // max(1, (own.own == j).sum()) if (own.own == j).any() else book[j] for j in range(16)])
        need = own.moved(x, new, np.sqrt(((new - book) ** 2).sum(1)) * (1 + 1e-12))
        book = new
        assert (own.own == ((x[:, None] - book) ** 2).sum(2).argmin(1)).all()
    assert (need == 0).mean() > 0.3 and (need <= 2).mean() > (need == 0).mean()


@pytest.mark.parametrize("operator,schema", [(substring_dedup.digest, DOCS), (conversation_trie.digest, TURNS), (vector_codes.digest, "vec_id long, embedding array<float>, label int")])
def test_empty_tables(spark, operator, schema):
    assert operator(spark.createDataFrame([], schema)).count() == 0


# --- what the operators share
def thue_morse(k):
    a, b = "a", "b"
    for _ in range(k):
        a, b = a + b, b + a
    return a, b


def test_built_collisions_of_words():
    """Thue-Morse words collide modulo 2^64 for every base; they are different words here."""
    import pyarrow as pa

    from tripwatch.llm.common import RangeHash, byte_codes, utf8, word_hashes, words

    data, offsets = utf8(pa.array([*thue_morse(12), thue_morse(12)[0].upper()]))
    starts, ends, _ = words(data, offsets)
    plain = RangeHash(data, byte_codes(4))(starts, ends)
    assert plain[0] == plain[1]
    got = word_hashes(data, starts, ends, byte_codes(4, fold_case=True), fold=True)
    assert got[0] != got[1] and got[0] == got[2]


def test_thue_morse_documents_are_no_near_copies(spark):
    from tripwatch.llm import near_dedup

    a, b = thue_morse(12)
    rows = near_dedup.digest(spark.createDataFrame([(1, a), (2, b), (3, a.upper())], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in rows) == [(1, 1, True), (2, 2, True), (3, 1, False)]


def test_samples_of_any_share(spark):
    from tripwatch.llm.common import chosen

    rows = spark.range(200_000)
    for share in (0.5, 1e-3, 1e-5):
        n = rows.where(chosen(share, "id")).count()
        assert abs(n - 200_000 * share) <= 5 * (200_000 * share) ** 0.5 + 1
    # under a millionth the share isn't rounded to none
    assert 0 < spark.range(40_000_000).where(chosen(2e-7, "id")).count() < 30
    assert rows.where(chosen(0.0, "id")).count() == 0


def test_language_is_learnt_from_a_tiny_share(spark):
    from tripwatch.llm import language_id

    docs = spark.range(2950).selectExpr("id as doc_id", "'the words of this text are plain enough' as text", "'en' as lang")
    assert language_id.fit(docs, rows=3).languages in (["en"], [])  # three rows as expected
    assert language_id.fit(docs, rows=60).languages == ["en"]


def test_repeated_pages_have_equal_verdicts(spark):
    from tripwatch.llm import url_filter

    page = (1, "https://a.example.com/en/x", '<a href="http://b.net/">')
    rows = url_filter.judged(spark.createDataFrame([page, page, (2, None, None), (2, None, None)], "page_id long, url string, html string")).collect()
    assert len(rows) == 4 and len(set(map(tuple, rows))) == 2
