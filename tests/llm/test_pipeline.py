"""The corpus pipeline against its stages one by one, and on odd tables."""

import pytest

import corpus_pipeline
from tripwatch.llm import language_id, near_dedup, packing, secret_scan, suffix_dedup

ROWS = [(1, None, "en"), (2, "", "en"), (3, "one short text", None), (3, "one short text", None), (None, "no id " * 20, "en"), (4, "word " * 3000, "en")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, spans string"


def plain(df):
    return sorted(map(str, df.drop("sequence_id", "offset").collect()))


def test_run_equals_its_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for step in (language_id.keep_known, near_dedup.deduplicate, suffix_dedup.deduplicate, secret_scan.redact):
        kept = step(docs)
        assert kept.columns == docs.columns
        docs = spark.createDataFrame(kept.collect(), kept.schema)
    assert plain(corpus_pipeline.run(spark, sf_dir)) == plain(packing.digest(docs))


@pytest.mark.parametrize("rows", [ROWS, []])
def test_stages_on_odd_tables(spark, tmp_path, rows):
    full = [(d, t, lang, "s", len(t or ""), "r", "x") for d, t, lang in rows]
    spark.createDataFrame(full, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() <= docs.count()
    assert corpus_pipeline.run(spark, str(tmp_path)).columns[:3] == ["doc_id", "piece", "start"]
