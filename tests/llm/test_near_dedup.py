import random
import re

import pytest

from tripwatch.llm import near_dedup as N


def shingles(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(ws)} if 0 < len(ws) < 5 else {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    key = lambda d: (d is None, d)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d, key=key)
    return sorted(((d, len(s), least[find(i)], d == least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def rows_of(n_base=25, copies=12):
    r = random.Random(3)
    vocabulary = ["".join(r.choices("abcdefghijk", k=r.randint(1, 7))) for _ in range(900)]
    rows = []
    for b in range(n_base):
        base = r.choices(vocabulary, k=r.randint(1, 150))
        for c in range(r.randint(1, copies)):
            ws = list(base)
            for _ in range(r.randint(0, max(1, len(ws) // 25))):
                ws[r.randrange(len(ws))] = r.choice(vocabulary)
            text = " ".join(ws)
            rows.append((len(rows) * 7 % 1009, text.upper() if r.random() < 0.1 else text.replace(" ", "\n\t", 2)))
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "One two"), (2004, "one TWO"), (2005, "É two"), (2006, "é two"), (None, "one two"), (2007, rows[0][1]), (2007, rows[0][1]), (2007, "else entirely here and there now"), (2008, "a b c d e"), (2009, " ".join(r.choices(vocabulary, k=20000)))]
    return rows


@pytest.mark.parametrize("block", [N.BLOCK, 3])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK", block)
    rows = rows_of() if block == N.BLOCK else rows_of(6, 20)
    got = N.digest(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_large_set_blocks():
    import numpy as np
    import pandas as pd

    big = np.arange(9_000_000)
    pdf = pd.DataFrame({"set_id": [1, 2, 1, 2], "shingles": [big, big[:7_000_000]] * 2, "asks": [True, True, False, False]})
    assert N._compare(pdf).to_numpy().tolist() == [[2, 1]] or N._compare(pdf).to_numpy().tolist() == [[1, 2]]


def test_empty_and_rows(spark):
    assert N.digest(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    docs = spark.createDataFrame([(2, "a b c d e f", 1), (1, "A b c d e f", 2), (1, "A b c d e f", 2), (3, None, 3)], "doc_id long, text string, kept int")
    assert sorted(map(tuple, N.deduplicate(docs).collect())) == [(1, "A b c d e f", 2), (3, None, 3)]


def test_long_texts(spark):
    """Texts of 20 MB: a near copy is linked on its whole set, one that shares only its first half isn't."""
    ws = [f"w{i:06d}" for i in range(2_500_000)]
    near = [*ws[:-200_000], *(f"n{i:06d}" for i in range(200_000))]
    half = [*ws[:1_250_000], *(f"h{i:06d}" for i in range(1_250_000))]
    docs = spark.createDataFrame([(3, " ".join(ws)), (1, " ".join(near).upper()), (2, " ".join(half))], "doc_id long, text string")
    assert sorted(map(tuple, N.digest(docs).collect())) == [(1, 2_499_996, 1, True), (2, 2_499_996, 2, True), (3, 2_499_996, 1, False)]
