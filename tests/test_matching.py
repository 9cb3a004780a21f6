"""Matching with distributions, parsing of odd messages, rounding of odd numbers, against results by hand."""

import math

import pytest
from pyspark.sql import functions as F

from tripwatch.functions import literals as L
from tripwatch.functions.terms import RDFS_RESOURCE, TYPE, XSD
from tripwatch.operators import matching as M
from tripwatch.sources import statements as ST

STATEMENT = "graph_id string, seq long, stmt_ix int, s string, p string, o_kind string, o_value string, o_dtype string, o_lang string"
PATTERN = "graph_id string, ap_id string, anchor string, relation string, st_kind string, st_value string, st_dtype string, st_dist string, st_members array<string>, st_lo double, st_hi double"


def st(ix, s, p, kind, value, dtype=None, lang=None, graph="g", seq=1):
    return (graph, seq, ix, s, p, kind, value, dtype and XSD + dtype, lang)


def ap(name, relation, kind=None, value=None, dtype=None, dist=None, members=None, lo=None, hi=None, anchor=RDFS_RESOURCE, graph="g"):
    return (graph, name, anchor, relation, kind, value, dtype and XSD + dtype, dist, members, lo, hi)


@pytest.fixture(scope="module")
def run(spark):
    def both(statements, nominal, candidates=()):
        a = M.anchored(spark.createDataFrame(statements, STATEMENT))
        got = M.two_stage(a, spark.createDataFrame(nominal, PATTERN), spark.createDataFrame(list(candidates), PATTERN)).orderBy("seq", "stmt_ix").collect()
        one = M.matched(a, spark.createDataFrame(nominal, PATTERN)).orderBy("seq", "stmt_ix").collect()
        if not candidates:
            assert [(r.ap_id, r.outcome, r.strong) for r in one if r.outcome != "remainder"] == [(r.ap_id, r.outcome, r.strong) for r in got if r.outcome != "remainder"]
        return [(r.stage, r.ap_id, r.outcome, r.strong) for r in got]

    return both


def test_distributions(run):
    """Two of a relation: a number meets the range, a name the members; a node meets neither."""
    statements = [st(0, "a", "r", "literal", "5", "double"), st(1, "a", "r", "literal", "x", "string"), st(2, "a", "r", "bnode", "_:b"), st(3, "a", "r", "iri", "u")]
    nominal = [ap("c", "r", dtype="double", dist="C", lo=1.0, hi=4.0), ap("d", "r", dtype="string", dist="D", members=["x", "y"])]
    candidates = [ap("u", "r", dtype="anyURI", dist="D", members=["v"])]
    assert run(statements, nominal, candidates) == [("nominal", "c", "pair", False), ("nominal", "d", "pair", True), ("candidate", None, "remainder", None), ("candidate", "u", "pair", False)]


def test_counts(run):
    statements = [st(0, "a", "one", "iri", "x"), st(1, "a", "new", "iri", "x"), st(2, "a", "two", "literal", "1", "integer"), st(3, "a", "two", "literal", "2", "integer")]
    nominal = [ap("o", "one", "literal", "7", "integer"), ap("t", "two", "literal", "1", "integer")]
    assert run(statements, nominal) == [("nominal", "o", "pair", False), ("nominal", None, "novel", None), ("nominal", "t", "pair", True), ("nominal", "t", "pair", False)]
    nominal += [ap("t2", "two", "literal", "9", "integer")]
    assert [x[2] for x in run(statements, nominal)] == ["pair", "novel", "conflict", "conflict"]


def test_classes_of_nodes_meet(run):
    """A blank node that is subject and object has its class on both sides."""
    statements = [st(0, "_:b", TYPE, "iri", "K"), st(1, "a", "r", "iri", "_:b"), st(2, "a", "r", "iri", "z"), st(3, "_:b", "q", "literal", "1", "integer")]
    a = run(statements, [ap("z", "r", "iri", "_:b")])
    assert a[1] == ("nominal", "z", "pair", True) and a[2][2] == "remainder"


def test_messages_without_patterns_and_empty_tables(run, spark):
    assert run([st(0, "a", "r", "iri", "x"), st(1, "a", "r", "iri", "y")], []) == [("candidate", None, "remainder", None)] * 2
    assert run([], []) == []


def test_parsing(spark):
    text = '<a> <b> <c> . <d> <e> <f> .\n_:n <p> _:m.\n<x><y>"v . w"@en . <x> <y> "1"^^<http://t> . junk\na b c .\n<x> <y> "a "b" c"^^d .\n<x> <y> "open .\n<x> <y> "" .'
    got = ST.parsed(spark.createDataFrame([("g", 1, text), ("g", 2, ""), ("g", 3, None)], "graph_id string, seq long, data string")).orderBy("stmt_ix").collect()
    assert [tuple(r)[2:] for r in got] == [
        (0, "a", "b", "iri", "c", None, None), (1, "d", "e", "iri", "f", None, None), (2, "_:n", "p", "bnode", "_:m", None, None), (3, "x", "y", "literal", "v . w", None, "en"),
        (4, "x", "y", "literal", "1", "http://t", None), (5, "a", "b", "iri", "c", None, None), (6, "x", "y", "literal", 'a "b" c', "d", None), (7, "x", "y", "literal", "", None, None),
    ]
    back = ST.parsed(ST.rendered(spark.createDataFrame(got), " ")).orderBy("stmt_ix").collect()
    assert [tuple(r) for r in back] == [tuple(r) for r in got]


def test_significant_is_total(spark):
    values = [0.0, -0.0, 1234567.0, -1245.0, 1e-310, 5e-324, 1.7976931348623157e308, 9.996e-5, math.inf, -math.inf, math.nan, None, 1e300, 3.14159e-250]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(L.significant(F.col("v"), 3)).collect()]
    for v, x in zip(values, got, strict=True):
        want = v if v is None or not math.isfinite(v) else float(f"{v:.2e}")
        assert x == want or (x is not None and math.isnan(x) and math.isnan(want)) or x == pytest.approx(want, rel=1e-12)
    for figures in (0, -1, 17, 40):
        assert spark.createDataFrame([(0.1,)], "v double").select(L.significant(F.col("v"), figures)).first()[0] == 0.1
