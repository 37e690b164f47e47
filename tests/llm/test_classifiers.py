import math
import random
import zlib

import numpy as np
import pytest

from textquarry.llm import quality_classifier, toxicity
from textquarry.llm.labelled import held_out, training_rows
from textquarry.llm.queries import queries
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, y int, part string"


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def corpus(rng, n):
    """Toxic texts hold one bad word in one sentence; junk is loud."""
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    docs, labels = [], []
    for i in range(n):
        sents = [" ".join(word() for _ in range(8)) for _ in range(6)]
        toxic, good = i % 4 == 0, i % 5 != 0
        if toxic:
            k = rng.randrange(6)
            sents[k] = f"{sents[k]} {rng.choice(['vilething', 'zogfool'])} here"
        text = ". ".join(sents) + "."
        if not good:
            text = " ".join(w.upper() + "###" for w in text.split())
        docs.append((i, text, "en", f"s{i % 3}", len(text), 0.5, 7, "x"))
        labels.append((i, int(good), int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus(random.Random(6), 600)
    docs += [(None, None, None, None, None, 0.0, 0, ""), (9000, "", "en", None, 0, 0.0, 0, ""), (9001, "calm words " * 20_000, "en", "s1", 1, 0.0, 0, "")]
    docs += [docs[3], docs[3]]
    return spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_rows_are_never_learnt(spark, tables):
    docs, labels = tables
    rows = training_rows(docs, labels, "toxic", 40).collect()
    assert not any(held(r.doc_id) for r in rows)
    assert sorted(sum(r.y == y for r in rows) for y in (0, 1)) == [40, 40]
    got = {r.doc_id: r.h for r in docs.select("doc_id", held_out(F.col("doc_id")).alias("h")).collect()}
    assert all(got[i] == held(i) for i in range(600)) and got[None] is False


def test_toxicity(spark, tables):
    docs, labels = tables
    out = toxicity.report(docs, labels).collect()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    test = [r for r in out if r.held_out and r.doc_id in truth]
    assert len(test) > 80 and sum(r.predicted == truth[r.doc_id] for r in test) >= 0.97 * len(test)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in test:
        if truth[r.doc_id]:
            assert any(w in texts[r.doc_id][r.worst_start : r.worst_end].lower() for w in ("vilething", "zogfool"))
    found = {r.doc_id for r in toxicity.locate(docs, toxicity.train(docs, labels)).collect()}
    assert len(found & {i for i, t in truth.items() if t}) >= 0.97 * sum(truth.values())
    empty = {r.doc_id: r.score for r in out if r.doc_id in (None, 9000)}
    assert all(s < 0.5 for s in empty.values())


def test_both_labels_take_no_part_and_bytes_are_bounded(spark, tables):
    docs, labels = tables
    twice = labels.unionByName(labels.where("doc_id < 40").selectExpr("doc_id", "quality", "1 - toxic AS toxic"))
    assert min(r.doc_id for r in training_rows(docs, twice, "toxic", 1000).collect()) >= 40
    some = training_rows(docs, labels, "toxic", 1000, train_bytes=5_000).collect()
    assert some and all(sum(len(r.text.encode()) for r in some if r.y == y) <= 5_000 for y in (0, 1))


def test_noisy_or():
    model = toxicity.WordWeights({"bad": 3.0, "worse": 5.0})
    got, worst, a, b = toxicity.score_text("Bad day. All fine! bad worse", -4.0, model)
    p = [1 / (1 + math.exp(-z)) for z in (-1.0, -4.0, 4.0)]
    assert got == pytest.approx(1 - np.prod([1 - x for x in p])) and worst == pytest.approx(p[2])
    assert "Bad day. All fine! bad worse"[a:b].strip() == "bad worse"


def test_toxicity_without_labels(spark, tables):
    docs, labels = tables
    assert max(r.score for r in toxicity.report(docs, labels.limit(0)).collect()) < 0.01
    assert toxicity.report(docs.limit(0), labels).count() == 0


def test_quality(spark, tables):
    docs, labels = tables
    out = quality_classifier.report(docs, labels).collect()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    test = [r for r in out if r.held_out and r.doc_id in truth]
    assert len(out) == docs.count() and sum(r.kept == bool(truth[r.doc_id]) for r in test) >= 0.97 * len(test)
    kept = quality_classifier.keep_good(docs, quality_classifier.train(docs, labels))
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in out if r.kept)
    assert all(r.score == 1 for r in quality_classifier.report(docs, labels.limit(0)).collect())
    assert quality_classifier.report(docs.limit(0), labels).count() == 0


def test_top_word_is_of_the_whole_text():
    top = lambda text: quality_classifier.content(text)[quality_classifier.CONTENT.index("top_word")]
    assert top("one two three four four") == 2 / 5 and top("") == 0
    assert top("first " + "word other " * 3_000) == 3_000 / 6_001


def test_co_training_draws_new_rows_from_all_unlabelled(spark):
    docs, labels = corpus(random.Random(8), 6000)
    labels = labels[:400]
    docs = spark.createDataFrame([*docs, docs[5000], (None, "x", "en", "s", 1, 0.0, 0, "")], SCHEMA)
    names = quality_classifier.known_names(docs)
    assert sorted(names[1].values()) == list(range(1, len(names[1]) + 1))
    rows = quality_classifier.table(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), names)
    pool = sorted((r.doc_id, r.x) for r in rows.where("y is null").collect())
    assert [p[0] for p in pool] == [i for i in range(400, 6000) if not held(i)]
    ids, x = np.array([p[0] for p in pool]), quality_classifier._split(np.array([p[1] for p in pool]))
    _, past, logits, y = quality_classifier.co_train(rows, names)
    assert all(len(z) == len(y) for z in logits)
    most = [int(quality_classifier.GIVEN * float(np.mean(y == k)) * len(pool)) for k in (0.0, 1.0)]
    assert len(past) == quality_classifier.ROUNDS
    for n in range(1, len(past) + 1):
        for labels in quality_classifier.given(ids, x, past[:n]):
            assert [int((labels == k).sum()) for k in (0, 1)] == [n * m for m in most]


def test_queries_on_held_out_labels(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    toxic = queries()["op1_toxicity"](spark, SF).join(labels, "doc_id").where("held_out").collect()
    good = queries()["op9_quality_classifier"](spark, SF).join(labels, "doc_id").where("held_out").collect()
    # More than a constant guess: right more often than one that calls nothing toxic, half of the toxic found, few others.
    assert sum(r.predicted == r.toxic for r in toxic) > sum(not r.toxic for r in toxic)
    hits = sum(r.predicted and r.toxic for r in toxic)
    assert hits >= 0.5 * sum(r.toxic for r in toxic) and hits >= 0.9 * sum(r.predicted for r in toxic)
    assert sum(r.kept == bool(r.quality) for r in good) >= 0.95 * len(good)
