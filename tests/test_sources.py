import json

from tripwatch.functions.terms import XSD
from tripwatch.sources import statements as ST


def test_lines(spark):
    text = '<a> <b> "x \\" y"@en .\nnonsense\n<a> <b> "1.5"^^<http://d> .\n<a> <b> <c> .\n_:n <b> _:m .\n<a> <b> plain .'
    got = ST.parsed(spark.createDataFrame([("g", 1, text), ("h", 1, ""), ("i", 1, None)], "graph_id string, seq long, data string")).orderBy("stmt_ix").collect()
    assert [(r.stmt_ix, r.o_kind, r.o_value, r.o_dtype, r.o_lang) for r in got] == [(0, "literal", 'x \\" y', None, "en"), (1, "literal", "1.5", "http://d", None), (2, "iri", "c", None, None), (3, "bnode", "_:m", None, None), (4, "iri", "plain", None, None)]


def test_stream_file_and_turns(spark, tmp_path):
    path = tmp_path / "s.json"
    path.write_text(json.dumps([[{"label": "a", "data": "d1"}, {"label": "a", "data": "d2", "anomaly": True}], [{"label": "b", "data": "d3"}]]))
    got = ST.round_robin(ST.stream_file(spark, str(path))).collect()
    assert [(r.stream, r.ix, r.graph_id, r.anomaly) for r in got] == [(0, 0, "a", None), (1, 0, "b", None), (0, 1, "a", True)]


def test_language_and_declared_types(spark):
    from pyspark.sql import functions as F

    from tripwatch.functions.literals import inferred, numeric

    rows = [("1", None, None), ("1.5", None, None), ("1e3", None, None), ("1_0", None, None), ("True", None, None), ("abc", None, None), ("", None, None), ("1", None, "en"), ("x", "d", None)]
    df = spark.createDataFrame(rows, "v string, d string, l string").withColumn("t", inferred(F.col("v"), F.col("d"), F.col("l")))
    assert [r.t.replace(XSD, "") for r in df.collect()] == ["integer", "float", "float", "integer", "string", "string", "string", "string", "d"]
    assert [r[0] for r in df.select(numeric(F.col("v"), F.col("t"))).collect()] == [1.0, 1.5, 1000.0, 10.0, None, None, None, None, None]


def test_settings_from_toml(tmp_path):
    import pytest

    from tripwatch.config import Settings

    path = tmp_path / "own.toml"
    path.write_text('grace_period = 7\nother = "x"\n[pattern]\nsamplesize = 20\npi_tolerance = 0.5\n[bad]\nalpha_critical = 1.5\n')
    assert Settings.from_toml(str(path)) == Settings(grace_period=7)
    assert Settings.from_toml(str(path), "pattern") == Settings(samplesize=20, pi_tolerance=0.5)
    assert Settings.from_toml(str(path), "none") == Settings()
    with pytest.raises(ValueError, match="out of range"):
        Settings.from_toml(str(path), "bad")
    for wrong in ({"samplesize": 1}, {"grace_period": 0}, {"samplegap": -1}, {"report_level": 6}, {"alpha_suspicious": 0}, {"pi_tolerance": -0.1}):
        with pytest.raises(ValueError, match="out of range"):
            Settings(**wrong)


def test_time_spans_and_kept_values(spark):
    from pyspark.sql import functions as F

    from tripwatch.functions.literals import kept_value, span_seconds

    got = spark.createDataFrame([("12H",), ("3D",), ("2W",), ("2Y",), ("H",), ("",), (None,), ("1h",), ("99999999999999999999H",)], "v string").select(span_seconds(F.col("v"))).collect()
    assert [r[0] for r in got] == [43200, 259200, 1209600, None, None, None, None, None, None]
    rows = [(" 12 ", "integer"), (" a b ", "string"), ("x", "integer"), ("2020-01-01", "date"), (None, "string")]
    got = spark.createDataFrame([(v, XSD + d) for v, d in rows], "v string, d string").select(kept_value(F.col("v"), F.col("d")).alias("k")).select("k.*").collect()
    assert [tuple(r) for r in got] == [(12.0, None), (None, "a b"), (None, "x"), (1577836800.0, None), (None, None)]
