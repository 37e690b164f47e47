"""Stages that keep a table's columns take any names, and null, repeated, empty and long rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from textquarry.llm import decontamination, quality_classifier, substring_dedup

SF = "/root/testdata/sf0.001"
EXTRA = ["d__", "t__", "m__", "d", "T", "m", "h", "r", "own_h", "a.b", "back`tick", "gone", "spans", "c", "digest", "y", "x", "key", "keeper"]
LONG = " ".join(f"w{i % 911}" for i in range(20_000))


def table(spark, rows):
    """Documents with further columns that hold doc_id each, so that mixed rows show."""
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.select("*", *[F.col("doc_id").cast("string").alias(c) for c in EXTRA])


@pytest.fixture(scope="module")
def odd(spark):
    some = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    more = [(None, None, None, None, None), (None, "", "en", None, 0), (9001, None, "en", "s", 0), (9002, "", None, "s", 0), (9003, LONG, "en", "s", len(LONG))]
    return some + more + some[:4] + more


def whole(df):
    """Every further column still belongs to its row."""
    rows = df.collect()
    assert all(r[c] == (None if r.doc_id is None else str(r.doc_id)) for r in rows for c in EXTRA)
    return sorted(((r.doc_id, r.text) for r in rows), key=repr)


@pytest.mark.parametrize("stage", [0, 1, 2, 3])
def test_stages(spark, odd, stage):
    docs, run = table(spark, odd), corpus_pipeline.STAGES[stage][1]
    kept = run(spark, docs, SF)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    rows = whole(kept)
    ids = {r[0] for r in odd}
    assert {i for i, _ in rows} <= ids and 0 < len(rows) <= len(odd)
    if stage in (1, 3):  # texts as they were, and repeated rows together
        plain = sorted(((r[0], r[1]) for r in odd), key=repr)
        assert rows == [r for r in plain if r in rows]
    assert run(spark, docs.where("false"), SF).count() == 0


def test_last_stage(spark, odd):
    docs = table(spark, odd)
    rows = corpus_pipeline.STAGES[4][1](spark, docs, SF).collect()
    assert sum(r.start == 0 for r in rows) == len(odd)
    assert corpus_pipeline.STAGES[4][1](spark, docs.where("false"), SF).count() == 0


def test_operators(spark, odd):
    docs, items = table(spark, odd), spark.createDataFrame([("i", " ".join(LONG.split()[100:110]))], "item_id string, text string")
    assert len(whole(decontamination.remove(docs, items))) == len(odd) - 2
    cleaned = {i: t for i, t in whole(decontamination.clean(docs, items))}
    assert len(cleaned[9003]) < len(LONG)
    assert len(whole(substring_dedup.dedup(docs, spans_name="spans_of_mine"))) == len(odd)
    assert len(whole(quality_classifier.keep_good(docs, {}))) == len(odd)
