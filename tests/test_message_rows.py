"""Matching inside message rows: equal to the general operators, and a table row is shuffled once."""

import re
from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from tripwatch.functions.terms import RDFS_RESOURCE, XSD
from tripwatch.operators import checks as C
from tripwatch.operators import matching as M
from tripwatch.operators import shacl as K
from tripwatch.plans import catalogue
from tripwatch.sources import statements as ST


@pytest.fixture(scope="module")
def tables(spark):
    """Orders without lines, lines without orders, orders and lines twice, line numbers that repeat, nulls."""
    orders = spark.createDataFrame([(1, "O", 10.5), (2, "F", None), (3, None, 1.0), (3, "P", 2.0), (None, "O", 3.0)], "o_orderkey long, o_orderstatus string, o_totalprice double")
    day = datetime(2020, 1, 1)
    lines = [(1, 5, 7, 2, 3.0, 1.0, "A", day), (1, 5, 7, 1, 30.0, 1.0, "R", day), (1, 5, 7, 1, 30.0, 1.0, "R", day), (3, 1, 1, 1, 2.0, 1.0, None, day), (4, 1, 2, 1, 9.0, 1.0, "N", None), (4, 1, 3, 4, None, 1.0, "N", day), (None, 1, 1, 1, 1.0, 1.0, "A", day)]
    return orders, spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_shipdate timestamp")


def rows_of(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("parts", [False, True])
def test_own_patterns_match_as_joined_ones(tables, parts):
    orders, lineitem = tables
    messages = ST.part_messages(lineitem) if parts else ST.order_messages(ST.dealt_orders(orders, lineitem))
    own = M.message_rows(messages)
    nameless = M.statements_of(own).where("graph_id is null").collect()  # nulls are equal to nothing, as in SQL
    assert len(nameless) == (3 if parts else 6) and {r.anchor for r in nameless} == {RDFS_RESOURCE}
    assert {r.ap_id for r in M.matched_messages(M.with_own_patterns(own, 6)).where("graph_id is null").collect()} == {None}
    messages = messages.where("graph_id is not null")
    own = M.message_rows(messages)
    a = M.anchored(ST.stated(messages))
    assert rows_of(M.statements_of(own)) == rows_of(a.select(*M.statements_of(own).columns))
    assert a.count() == 3 * (lineitem.count() - 1 + (0 if parts else orders.count() - 1))
    patterns = M.static_patterns(a.where("stmt_ix < 6"))
    told, want = M.matched_messages(M.with_own_patterns(own, 6)), M.matched(a, patterns)
    assert rows_of(told.drop("ap")) == rows_of(want)
    assert {r.outcome for r in want.select("outcome").distinct().collect()} >= {"pair"}
    if not parts:
        named = M.own_multiplicities(M.with_own_patterns(own, 6))
        assert rows_of(named) == rows_of(M.multiplicities(a, patterns))
    per = want.groupBy("graph_id").agg(F.count_if(F.col("outcome") == "pair").alias("pairs"), F.count_if(F.col("outcome") == "remainder").alias("unmatched"))
    size = patterns.groupBy("graph_id").agg(F.count("*").alias("size"))
    counts = M.structure_counts(M.with_own_patterns(own, 6))
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, per.join(size, "graph_id").collect()))


def test_a_pairs_own_pattern_is_checked_as_a_joined_one(spark):
    rows = [("g", s, 0, "a", "p", "iri", f"x{s % 2}", None, None) for s in (1, 2, 3)] + [("g", s, 1, "a", "q", "literal", str(s), None, "en" if s < 3 else "nl") for s in (1, 2, 3)]
    a = M.anchored(spark.createDataFrame(rows, "graph_id string, seq long, stmt_ix int, s string, p string, o_kind string, o_value string, o_dtype string, o_lang string"))
    patterns = M.static_patterns(a.where("seq = 1"))
    pairs = M.matched_messages(M.with_known(M._message_rows(a.where("seq > 1")), patterns, "aps")).where("outcome = 'pair'")
    got = rows_of(C.own_checks(pairs))
    assert got == rows_of(C.static_checks(M.matched(a.where("seq > 1"), patterns).where("outcome = 'pair'"), patterns)) and len(got) == 4


@pytest.mark.parametrize("name", ["match_conflicts", "match_weak", "match_unambiguous", "match_remainder", "match_classes", "match_two_stage", "structure_checks", "anchor_relation_counts", "shape_statements"])
def test_table_rows_are_shuffled_once(spark, sf_dir, name):
    """One exchange, of rows of the tables, and no sort or join of statements."""
    plan = catalogue.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    if name == "shape_statements":  # statements come after the exchange
        assert len(re.findall(r"\bExchange\b", plan)) == 1
        return
    assert len(re.findall(r"\bExchange\b", plan)) == 1 and "Join" not in plan and "Window" not in plan


def test_checked_pairs_deal_no_message_by_its_stream(spark, sf_dir):
    plan = catalogue.queries()["checked_pairs"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan


def test_texts_are_parsed_inside_message_rows(spark, sf_dir):
    """No statement is shuffled or sorted: events have their places, and that is all."""
    plan = catalogue.queries()["parse_ntriples"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Sort" not in plan and "Aggregate" not in plan


def test_message_rows_are_rendered_parsed_and_grouped_as_statements(spark):
    rows = [("g", 1, i, *x) for i, x in enumerate([("_:b", "p", "iri", "x", None, None), ("a", "q", "literal", "1", XSD + "integer", None), ("a", "p", "literal", "v $1 w", None, "en-GB"), ("a", "p", "bnode", "_:b", None, None), ("a", "r", "literal", "", None, None)])] + [("h", 1, 0, "a", "p", "iri", "y", None, None), (None, 2, 0, "a", "p", "iri", "z", None, None)]
    statements = spark.createDataFrame(rows, "graph_id string, seq long, stmt_ix int, s string, p string, o_kind string, o_value string, o_dtype string, o_lang string")
    messages = statements.groupBy("graph_id", "seq").agg(F.sort_array(F.collect_list(F.struct(*statements.columns[2:]))).alias("sts"))
    texts = ST.rendered_messages(messages)
    assert rows_of(texts) == rows_of(ST.rendered(statements))
    assert rows_of(ST.stated(ST.parsed_messages(texts))) == rows_of(ST.parsed(texts)) == rows_of(statements)
    got = ST.by_relation(messages).select("graph_id", "seq", "p", F.size("own").cast("long").alias("n"), F.array_max("own.o_value").alias("v"))
    assert rows_of(got) == rows_of(statements.groupBy("graph_id", "seq", "p").agg(F.count("*").alias("n"), F.max("o_value").alias("v")))


def test_white_space_between_terms_is_no_part_of_them(spark):
    text = '<a>\t<b>\r\n"x y"\t.\n_:n\t \tq\t<c>\t.\n<a>\n<b> "v"^^<> .'
    got = ST.parsed(spark.createDataFrame([("g", 1, text)], "graph_id string, seq long, data string")).orderBy("stmt_ix").collect()
    assert [tuple(r)[3:] for r in got] == [("a", "b", "literal", "x y", None, None), ("_:n", "q", "iri", "c", None, None), ("a", "b", "literal", "v", None, None)]


def test_a_reports_text_is_made_inside_its_row(spark, sf_dir):
    """Lines of orders are shuffled once, and no statement is."""
    plan = catalogue.queries()["report_texts"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bExchange\b", plan)) == 1 and "collect_list" not in plan and "Generate" not in plan


def test_report_rows_hold_the_statements_of_their_reports(spark):
    found = "result_id string, label string, message string, severity string, focus string, path string, value string"
    ends = [("v1", "L", "m", "CRITICAL", "f", "p", "1"), ("v2", "L", "n", "NODATA", None, None, None)]
    reports = spark.createDataFrame([("r1", 1, False, ends), ("r2", 2, True, None), ("r3", 3, True, []), ("r4", 4, False, ends[1:])], f"report_id string, report_ts long, conforms boolean, violations array<struct<{found}>>")
    rows, statements = K.report_messages(reports), K.report_statements(reports.drop("violations"), reports.select("report_id", F.inline("violations")))
    assert rows_of(rows.select("graph_id", F.inline("sts"))) == rows_of(statements) and statements.count() == 4 * 5 + 2 * 8 + 11
    texts = K.message_texts(rows)
    assert rows_of(texts) == rows_of(K.report_texts(statements))
    lines = texts.where("graph_id = 'r1'").first().text.split("\n")
    assert len(lines) == 2 + 5 + 8 + 11 and lines[1:-1] == sorted(lines[1:-1])


@pytest.mark.parametrize("name", ["report_texts", "report_structural"])
def test_reports_on_lines_without_flags_or_keys_equal_sql(spark, tmp_path, name):
    spark.createDataFrame([(1, "A"), (1, None), (2, None), (2, None), (3, None), (3, "R"), (4, "R")] + ([(None, "N")] if name == "report_texts" else []), "l_orderkey long, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = db.sql(catalogue.oracle_sql()[name]).fetchall()
    assert sorted(map(repr, map(tuple, catalogue.queries()[name](spark, str(tmp_path)).collect()))) == sorted(map(repr, want))
