import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from test_jaccard_join import brute
from test_native import contaminated
from test_tokens import check_packed
from textquarry.llm import packing, storage
from textquarry.llm.labelled import training_rows
from textquarry.llm.substring_dedup import removable
from test_substring_dedup import brute as repeats

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        new = storage.written(stage(spark, docs, SF), f"test-{name}")
        out.append((docs, new))
        docs = new
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_quality_keeps_good(spark, steps):
    before, after = steps[0]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = texts(after)
    good = [d for d in texts(before) if labels.get(d) == 1]
    assert after.columns == before.columns and sum(d in kept for d in good) >= 0.95 * len(good)


def test_one_of_each_group(steps):
    before, after = steps[1]
    want = {d for d, _, c in brute(sorted(texts(before).items())) if d == c}
    assert set(texts(after)) == want and after.columns == before.columns


def test_passages(steps):
    before, after = (texts(x) for x in steps[2])
    marked = repeats(before)
    for d, t in before.items():
        data, at, kept = t.encode(), 0, b""
        for a, b, _ in removable(data, marked.get(d, {})):
            kept, at = kept + data[at:a], b
        assert after[d] == (kept + data[at:]).decode()
    assert all(r.n_chars == len(r.text) for r in steps[2][1].collect())


def test_benchmark(spark, steps):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = (texts(x) for x in steps[3])
    assert set(after) == {d for d, t in before.items() if not contaminated(t, items)[4]}


def test_packed(steps):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: [*library.encode(t or "", add_special_tokens=False).ids, 1] for d, t in texts(steps[4][0]).items()}
    check_packed(steps[4][1].collect(), ids, 2048)


def test_run_is_the_stages(spark, steps):
    assert corpus_pipeline.run(spark, SF).select("doc_id").distinct().count() == steps[4][0].count()


def test_stages_hand_small_batches_to_workers(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    many = docs.crossJoin(spark.range(40).select()).select(docs.columns).coalesce(1)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)

    def sizes(stream):
        for batch in stream:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    try:
        for stage in (corpus_pipeline.quality, corpus_pipeline.repeated_passages):
            spark.conf.set(name, "10000")
            stage(spark, docs.limit(20), SF)
            assert many.count() > 5000 and max(r.n for r in many.mapInArrow(sizes, "n long").collect()) <= 1000
        spark.conf.set(name, "300")
        storage.lasting_small_batches(spark)
        assert spark.conf.get(name) == "300"
    finally:
        spark.conf.set(name, before)


def test_local_rows_need_no_workers_of_their_own(spark, capsys):
    labels, docs = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/documents.parquet")
    files = packing.encode(docs.limit(20), storage.new_folder(spark, "test"), public_tokenizers.path("byte_bpe_50k.json"), 1)
    for df in (training_rows(docs, labels, "quality", 30), packing.pieces(spark, files), storage.local(spark, [], a=pa.int64())):
        df.explain()
        assert "ExistingRDD" not in capsys.readouterr().out
        df.collect()
    rows = [(1, None), (2, "x")]
    assert [tuple(r) for r in storage.local(spark, rows, a=pa.int64(), b=pa.string()).collect()] == rows
