"""Gated intervals, places, order statistics and draws against plain versions."""

import bisect

import numpy as np
import pytest

from tripwatch.config import Settings
from tripwatch.operators import gate, sequence
from tripwatch.operators import statistics as S
from tripwatch.operators.fold import bootstrap, interval, step

SAMPLES = "graph_id string, seq long, value double"


def streams():
    rng = np.random.default_rng(1)
    out = []
    for g, n in (("a", 900), ("b", 50), ("c", 500), ("d", 101)):
        values = np.cumsum(rng.normal(size=n)) * 0.5 if g == "c" else rng.exponential(size=n).round(1)
        out += [(g, i + 1, float(v)) for i, v in enumerate(values)]
    return out


def one_by_one(rows, s):
    out, accepted = [], {}
    for g, seq, v in rows:
        own, code = accepted.setdefault(g, []), 0
        if len(own) >= 100:
            for alpha, c in ((s.alpha_critical, 5), (s.alpha_suspicious, 4)):
                lo, hi = interval(own, 1 - alpha)
                by = abs(hi - lo) * s.pi_tolerance
                if v <= lo - by or v > hi + by:
                    code = c
                    break
        if not code:
            bisect.insort(own, v)
        out.append((g, seq, code))
    return sorted(out)


@pytest.mark.parametrize("block", [4096, 60])
def test_gated_intervals_equal_one_by_one(spark, block):
    rows = streams()
    got = gate.interval_codes(spark.createDataFrame(rows, SAMPLES), Settings(), block)
    want = one_by_one(rows, Settings())
    assert sum(c > 0 for *_, c in want) > 50
    assert sorted((r.graph_id, r.seq, r.code) for r in got.collect()) == want


def test_gated_intervals_equal_the_fold(spark, sf_dir):
    """The interval findings of the fold, over messages of one value each."""
    from tripwatch.functions.terms import XSD
    from tripwatch.plans import catalogue

    events = catalogue._events(spark, sf_dir).select("graph_id", "seq", "value")
    s = Settings(samplesize=10**6)  # no population: the fold does no fit test
    want, state = [], {}
    for g, seq, v in sorted(map(tuple, events.collect())):
        row = (0, "C", "r", "literal", str(v), XSD + "double", None, v, "s")
        state[g], found, _ = step(state.get(g), g, seq, [row], s)
        want.append((g, seq, max((f[3] for f in found if f[3] > 2), default=0)))
    got = gate.interval_codes(events, s).select("graph_id", "seq", "code").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_gated_intervals_of_nothing(spark):
    assert gate.interval_codes(spark.createDataFrame([], SAMPLES)).count() == 0
    assert gate.interval_codes(spark.createDataFrame([("a", 1, None), ("a", 2, 1.0)], SAMPLES)).count() == 1


def test_places(spark):
    rng = np.random.default_rng(3)
    rows = [(f"k{k}" if k else None, float(v), i) for i, (k, v) in enumerate(zip(rng.integers(0, 4, 3000), rng.integers(0, 50, 3000), strict=True))]
    got = sequence.placed(spark.createDataFrame(rows, "k string, v double, i long").repartition(16), ["k"], ["v", "i"]).collect()
    want = {}
    for k in {r[0] for r in rows}:
        for n, r in enumerate(sorted((v, i) for kk, v, i in rows if kk == k)):
            want[r[1]] = n + 1
    assert {r.i: r.place for r in got} == want
    got = sequence.running(spark.createDataFrame(rows, "k string, v double, i long"), ["k"], ["i"], "v").collect()
    upto = {}
    for r in sorted(got, key=lambda r: r.i):
        assert r.before == upto.get(r.k, 0)
        upto[r.k] = r.before + r.v


@pytest.mark.parametrize("most", [1 << 16, 7])
def test_order_statistics(spark, most):
    rng = np.random.default_rng(5)
    data = {"a": (rng.normal(size=4000) * 10.0 ** rng.integers(-200, 200, 4000)).tolist(), "b": rng.integers(0, 3, 1000).astype(float).tolist(), "c": [1.5], "d": [2.0] * 400}
    ranks = {"a": [0, 1, 19, 20, 1999, 3980, 3999], "b": [0, 300, 500, 999], "c": [0], "d": [0, 399]}
    rows = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs] + [("a", None)], "graph_id string, value double")
    asked = spark.createDataFrame([(k, r) for k, rs in ranks.items() for r in rs], "graph_id string, rank long")
    got = sequence.order_statistics(rows, asked, most=most).collect()
    assert sorted(map(tuple, got)) == sorted((k, r, sorted(data[k])[r]) for k, rs in ranks.items() for r in rs)


def _side(spark, values):
    return spark.createDataFrame([("g", float(v)) for v in values], "graph_id string, value double")


def test_draws_are_with_replacement(spark):
    """1000 different resamples of 51 values, most with a repeated one, and every value about as often as the others."""
    sample = _side(spark, range(51))
    draws = S.drawn(sample, S._plan(sample, 1000, 0.67, "graph_id"), "b").collect()
    sets = {}
    for d in draws:
        sets.setdefault(d.r, []).append(d.value)
    assert len(sets) == 1000 and all(len(x) == 34 for x in sets.values())
    assert len({tuple(sorted(x)) for x in sets.values()}) == 1000
    assert sum(len(set(x)) < 34 for x in sets.values()) > 990
    often = np.bincount([int(d.value) for d in draws], minlength=51)
    assert abs(often - 34000 / 51).max() < 6 * (34000 / 51) ** 0.5


def test_bootstrap_is_near_numpys(spark):
    rng = np.random.default_rng(11)
    population, sample = rng.exponential(size=1500).round(3), rng.exponential(size=51).round(3) * 1.1
    got = S.bootstrap(_side(spark, sample), _side(spark, population)).first()
    want = np.mean([bootstrap(list(sample), list(population), True, 1000, np.random.default_rng(i)) for i in range(5)], 0)
    assert np.abs(np.array([got.p_mean, got.p_sd, got.p_median]) - want).max() < 0.05


def test_discrete_bootstrap(spark):
    """By hand: a value of one side only has no valid resample; of two sides with one value each, neither is less."""
    got = {r.value: (r.n_valid, r.p) for r in S.bootstrap_discrete(_side(spark, [1] * 51), _side(spark, [1] * 40 + [2] * 0)).collect()}
    assert got == {1.0: (1000, 0.0)}
    got = {r.value: (r.n_valid, r.p) for r in S.bootstrap_discrete(_side(spark, [1] * 51), _side(spark, [2] * 40)).collect()}
    assert got == {1.0: (0, None), 2.0: (0, None)}
    rng = np.random.default_rng(2)
    population, sample = rng.choice(3, 800, p=[0.2, 0.3, 0.5]).tolist(), rng.choice(4, 51, p=[0.3, 0.3, 0.3, 0.1]).tolist()
    p = S.bootstrap_discrete(_side(spark, sample), _side(spark, population))
    got = [r.p for r in p.orderBy("value").collect()]
    want = np.mean([bootstrap(sample, population, False, 1000, np.random.default_rng(i))[:3] for i in range(5)], 0)
    order = [list(dict.fromkeys([*population, *sample])).index(v) for v in range(3)]
    assert np.abs(np.array(got[:3]) - want[order]).max() < 0.05 and got[3] is None
    assert S.any_rejected(p, 0.01).first().rejected == any(x is not None and (x < 0.005 or x > 0.995) for x in got)
    grid = {r.value: (r.share_a, r.share_b) for r in S.proportion_grid(_side(spark, [1, 1, 2]), _side(spark, [2, 3])).collect()}
    assert grid == {1.0: (2 / 3, None), 2.0: (1 / 3, 0.5), 3.0: (None, 0.5)}


def test_values_of_rejected_messages_are_not_learnt(spark):
    """Where `fine` is false a value isn't learnt, whatever its own code is; in blocks of any size."""
    rng = np.random.default_rng(8)
    rows = [("g", i + 1, float(v), bool(i < 100 or rng.random() < 0.7)) for i, v in enumerate(rng.exponential(size=600).round(2))]
    s, own, want = Settings(), [], []
    for _, seq, v, fine in rows:
        code = 0
        if len(own) >= 100:
            for alpha, c in ((s.alpha_critical, 5), (s.alpha_suspicious, 4)):
                lo, hi = interval(own, 1 - alpha)
                by = abs(hi - lo) * s.pi_tolerance
                if v <= lo - by or v > hi + by:
                    code = c
                    break
        want.append((seq, len(own), code))
        if not code and fine:
            bisect.insort(own, v)
    for block in (4096, 70):
        got = gate.interval_codes(spark.createDataFrame(rows, SAMPLES + ", fine boolean"), s, block).select("seq", "n", "code").collect()
        assert sorted(map(tuple, got)) == want


def test_other_statistics(spark):
    from pyspark.sql import functions as F

    p = S.bootstrap(_side(spark, range(51)), _side(spark, range(100, 200)), 50, statistics={"top": F.max, "mean": F.avg}).first()
    assert p.asDict() == {"graph_id": "g", "p_top": 0.0, "p_mean": 0.0}


def test_a_large_stream_is_many_tasks(spark):
    """A third of all rows are one stream's: no range has more than twice the mean."""
    from pyspark.sql import functions as F

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(60_000).selectExpr("if(id % 3 = 0, 'hot', concat('s', id % 500)) as k", "xxhash64(id) as t")
        sizes = [r["count"] for r in sequence.ranged(rows, ["k"], [F.col("t")]).groupBy("_part").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 8 and max(sizes) <= 2 * 60_000 / 8


def test_passes_move_about_as_much_as_the_stream_has(spark, monkeypatch):
    """Past values that go to blocks are about as many as the messages that a pass judges, and settled blocks are judged no more."""
    seen = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    own = gate.judged_block

    def counted(rows, levels, tolerance):
        seen[0].add(int((rows.kind == 0).sum()))
        seen[1].add(int((rows.kind == 1).sum()))
        return own(rows, levels, tolerance)

    monkeypatch.setattr(gate, "judged_block", counted)
    values = np.random.default_rng(8).random(4000)
    rows = [("g", i + 1, float(v)) for i, v in enumerate(values)]
    got = gate.interval_codes(spark.createDataFrame(rows, SAMPLES), Settings(), 250)
    assert got.count() == len(rows)
    assert 0 < seen[0].value < 2 * seen[1].value
