import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tripwatch.llm import suffix_dedup as S
from tripwatch.llm.suffix_dedup import LENGTH, RunLengthIndex, deduplicate, digest


def brute(rows):
    raws = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(r[i : i + LENGTH] for _, r in raws for i in range(len(r) - LENGTH + 1))
    out = []
    for d, r in raws:
        hit = bytearray(len(r))
        for i in range(len(r) - LENGTH + 1):
            if seen[r[i : i + LENGTH]] > 1:
                hit[i : i + LENGTH] = b"\1" * LENGTH
        spans = sum(1 for i in range(len(r)) if hit[i] and (i == 0 or not hit[i - 1]))
        kept = bytes(b for b, h in zip(r, hit) if not h)
        out.append((d, len(r), sum(hit), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows_of():
    r = random.Random(5)
    words = [bytes(r.choices(b"abcdefgh", k=r.randint(2, 8))).decode() for _ in range(300)] + ["é", "ß", "日本"]
    prose = lambda n: " ".join(r.choices(words, k=n))
    shared, base = prose(70), prose(200)
    rows = [(i, prose(r.randint(0, 120))) for i in range(40)]
    rows += [(100 + i, prose(40) + shared + prose(40)) for i in range(6)]
    rows += [(200 + i, base) for i in range(3)] + [(210, base[7:]), (211, base + base), (212, "a" * 1000), (213, "ab" * 99), (214, "x" * 199), (215, "x" * 200)]
    rows += [(300, None), (301, ""), (None, shared), (302, "y" * 201), (302, "z" * 50 + shared[:230]), (5, rows[5][1]), (5, rows[5][1]), (303, prose(3000) + shared + prose(3000))]
    return rows


@pytest.mark.parametrize("crowd", [S.CROWD, 2])
def test_against_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(S, "CROWD", crowd)
    rows = rows_of()
    got = digest(spark.createDataFrame([(d, t, "en") for d, t in rows], "doc_id long, text string, spans string"))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_small_steps(monkeypatch):
    monkeypatch.setattr(S, "STRIP", 500)
    data = np.frombuffer(("q" * 300 + "".join(chr(97 + i * i % 23) for i in range(3000))).encode(), np.uint8)
    got = sorted((int(r), int(s) + i) for r, s, w, _, _ in ((a, b, c, d, e) for x in S._segments_of(data, np.array([0, 100, len(data)]), 200, 32) for a, b, c, d, e in zip(*x)) for i in range(int(w)))
    assert got == [(1, i) for i in range(len(data) - 100 - 199)]


def test_index_statistics():
    r = random.Random(1)
    for _ in range(30):
        strings = ["".join(r.choices("ab", k=r.randint(1, 20))) for _ in range(r.randint(1, 8))]
        data = np.frombuffer("".join(strings).encode(), np.uint8)
        offsets = np.cumsum([0, *map(len, strings)])
        got = RunLengthIndex(data, offsets).matching_statistics()
        suffixes = [s[i:] for s in strings for i in range(len(s))]
        common = lambda a, b: next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        assert got.tolist() == [max([common(a, b) for j, b in enumerate(suffixes) if j != i], default=0) for i, a in enumerate(suffixes)]


def test_empty_and_text(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert digest(empty).collect() == []
    base = "é" * 150
    got = deduplicate(spark.createDataFrame([(1, "A" + base, 7), (2, "B" + base, 7), (3, None, 7)], "doc_id long, text string, n_chars long"))
    assert sorted(map(tuple, got.collect())) == [(1, "A", 1), (2, "B", 1), (3, None, 7)]
