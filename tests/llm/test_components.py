"""Components of edge tables against a union-find by hand, and what a round hands on to the next."""

import random

from tripwatch.llm import components as C


def test_rounds_hand_on_edges_between_parts_only(spark, monkeypatch):
    """A chain of shuffled names, a hub and a dense group: the rows of all rounds are in proportion to the edges."""
    rng, written, write = random.Random(5), [], C.materialise
    names = rng.sample(range(1000), 120)
    edges = list(zip(names, names[1:], strict=False)) + [(2000, i) for i in range(2001, 2060)] + [(a, b) for a in range(3000, 3025) for b in range(3000, a)] + [(7, 7), (None, 8), (9, None)]

    def noted(df):
        out = write(df)
        if out.columns == ["node", "next"]:
            written.append(out.count())
        return out

    monkeypatch.setattr(C, "materialise", noted)
    got = {r.node: r.root for r in C.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == dict.fromkeys(names, min(names)) | dict.fromkeys(range(2000, 2060), 2000) | dict.fromkeys(range(3000, 3025), 3000)
    assert written[-1] == 0 and all(b <= a / 2 for a, b in zip(written, written[1:], strict=False))
