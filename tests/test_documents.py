import math
import random

import pytest

from textquarry.plans import documents as d
from textquarry.plans import store
from textquarry.plans.documents import And, Not, Or, Phrase, Word

LAYOUT = d.Documents(("text", "title"), ("lang",))
WORDS = ["me", "the", "Met", "home", "so"]


def rows_of(rng, n, first=0):
    return [(i, " ".join(rng.choices(WORDS, k=rng.randrange(9))) if rng.random() < 0.9 else None, rng.choice(["Home me", "", None, "x"]), rng.choice(["en", "de", None])) for i in range(first, first + n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, title string, lang string")


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng, root = random.Random(2), str(tmp_path_factory.mktemp("documents"))
    one, two, three = rows_of(rng, 500), rows_of(rng, 300, 500), rows_of(rng, 20, 40)
    store.build(frame(spark, one + one[:5]), root, LAYOUT)  # repeated rows are one document
    store.append(frame(spark, [*two, (None, "me the", None, "en")]), root, LAYOUT)
    store.delete(spark.createDataFrame([(i,) for i in range(30, 90)], "doc_id long"), root, LAYOUT)
    store.append(frame(spark, three), root, LAYOUT)  # some ids again
    alive = [r for r in one + two if not 30 <= r[0] < 90] + three
    return root, alive


def words(text):
    return (text or "").lower().split()


def starts(text, phrase):
    w = words(text)
    return [i for i in range(len(w) - len(phrase) + 1) if w[i : i + len(phrase)] == list(phrase)]


@pytest.mark.parametrize("phrase", [("me",), ("the", "me"), ("met", "met", "the"), ("so", "so"), ("me", "nowhere"), ("home", "so", "me", "the")])
def test_phrases(spark, made, phrase):
    root, alive = made
    want = sorted((r[0], len(s), s[0]) for r in alive if (s := starts(r[1], phrase)))
    assert sorted(tuple(r) for r in d.phrase_search(d.Index(spark, root), list(phrase)).collect()) == want


def holds(e, row):
    if isinstance(e, Word):
        return e.word in words(row[1] if e.field == "text" else row[2])
    if isinstance(e, Phrase):
        return bool(starts(row[1] if e.field == "text" else row[2], e.words))
    if isinstance(e, Not):
        return not holds(e.part, row)
    return (all if isinstance(e, And) else any)(holds(p, row) for p in e.parts)


@pytest.mark.parametrize(
    "e",
    [
        And(Word("me"), Word("the")),
        And(Word("me"), Not(Word("the")), Or(Word("so"), Word("home", "title"))),
        Not(Or(Word("me"), Phrase(("so", "the")))),
        Or(Not(Word("me")), Word("so")),
        And(Not(Word("me")), Not(Word("so"))),
        And(Phrase(("home", "me"), "title"), Word("met")),
        Not(Not(Word("nowhere"))),
    ],
)
def test_expressions(spark, made, e):
    root, alive = made
    assert sorted(r.doc_id for r in d.boolean_search(d.Index(spark, root), e).collect()) == sorted(r[0] for r in alive if holds(e, r))


def ranked(alive, terms, weights, k):
    score = {r[0]: 0.0 for r in alive}
    for field, weight in weights.items():
        c = 1 if field == "text" else 2
        mean = sum(len(words(r[c])) for r in alive) / len(alive)
        for t in terms:
            df = sum(t in words(r[c]) for r in alive)
            for r in alive:
                n = words(r[c]).count(t)
                score[r[0]] += weight * math.log(1 + (len(alive) - df + 0.5) / (df + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(words(r[c])) / mean)) if n else 0
    return sorted(((-round(s, 6), i) for i, s in score.items() if s > 0))[:k]


@pytest.mark.parametrize("k", [1, 7, 1000])
def test_ranking(spark, made, k):
    root, alive = made
    index = d.Index(spark, root)
    assert index.size("text") == (len(alive), sum(len(words(r[1])) for r in alive))
    assert index.frequencies(["Met", "nowhere"]) == {"met": sum("met" in words(r[1]) for r in alive), "nowhere": 0}
    got = [(-r.score, r.doc_id) for r in d.bm25_search(index, ["me", "home", "home"], {"text": 1.0, "title": 0.3}, k).collect()]
    assert [i for _, i in got] == [i for _, i in ranked(alive, ["me", "home"], {"text": 1.0, "title": 0.3}, k)]
    assert d.bm25_search(index, ["nowhere"], {"text": 1.0}).count() == 0


def test_blocks_are_skipped(spark, tmp_path):
    """The best document lies in one block; the others can't reach it, and their postings are not read."""
    rows = [(i, "me " + "so " * 50, None, "en") for i in range(3000)] + [(10_000, "me me me", None, "en")]
    store.build(frame(spark, rows), str(tmp_path), LAYOUT)
    assert [r.doc_id for r in d.bm25_search(d.Index(spark, str(tmp_path)), ["me"], {"text": 1.0}, 1).collect()] == [10_000]
    blocks = d.reachable_blocks(*d.block_scores(d.Index(spark, str(tmp_path)), ["me"], {"text": 1.0}), 1)
    assert [r.block for r in blocks.collect()] == [10_000 >> d.BLOCK_BITS]


def test_facets(spark, made):
    root, alive = made
    hit = [r for r in alive if "me" in words(r[1])]
    got = {(r.lang, r.grouping): r.n_docs for r in d.facets(d.Index(spark, root), Word("me"), ["lang"]).collect()}
    want = {(None, 1): len(hit)} | {(g, 0): n for g in ("en", "de", None) if (n := sum(r[3] == g for r in hit))}
    assert got == want


def test_compaction_and_snapshot(spark, made, tmp_path):
    root, alive = made
    store.compact(spark, root, str(tmp_path), LAYOUT)
    one, two = d.Index(spark, root), d.Index(spark, str(tmp_path))
    assert len(two.version.segments) == 1
    assert sorted(d.phrase_search(one, ["the", "me"]).collect()) == sorted(d.phrase_search(two, ["the", "me"]).collect())
    assert [tuple(r) for r in d.bm25_search(one, ["me", "so"], {"text": 1.0}, 20).collect()] == [tuple(r) for r in d.bm25_search(two, ["me", "so"], {"text": 1.0}, 20).collect()]
    first = d.Index(spark, root, 0)
    assert {r.doc_id for r in d.boolean_search(first, Word("me")).collect()} != {r.doc_id for r in d.boolean_search(one, Word("me")).collect()}
    assert max(r.doc_id for r in first.rows("lengths").collect()) == 499


def test_plans_read_the_index_alone(spark, made):
    root, _ = made
    for found in (d.phrase_search(d.Index(spark, root), ["the", "me"]), d.boolean_search(d.Index(spark, root), And(Word("me"), Not(Word("so"))))):
        plan = found._jdf.queryExecution().toString()
        assert "EqualTo(word,me)" in plan and "n_words" not in plan and "split(" not in plan


def test_same_id_other_text(spark, tmp_path):
    store.build(frame(spark, [(1, "me so", None, "en"), (1, "so the", None, "en"), (2, "", None, "en")]), str(tmp_path), LAYOUT)
    index = d.Index(spark, str(tmp_path))
    assert d.boolean_search(index, And(Word("me"), Word("the"))).count() == 0
    assert [r.doc_id for r in d.boolean_search(index, Or(Word("me"), Word("the"))).collect()] == [1]
    assert d.phrase_search(index, ["so"]).first().n_hits == 2
    with pytest.raises(FileNotFoundError):
        d.Index(spark, str(tmp_path / "none"))


def test_places_of_a_batch(monkeypatch):
    """Batches are taken in steps; null and empty texts have no row, words over the size limit only take their place."""
    import pyarrow as pa

    rng = random.Random(4)
    cut = [None if i % 7 == 0 else [rng.choice(["me", "so", "x" * 300, "the"]) for _ in range(rng.randrange(0, 9))] for i in range(60)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(60)), "key": [1] * 60, "field": ["text"] * 60, "w": pa.array(cut, pa.list_(pa.string()))})
    want = sorted((i, w, [p for p, x in enumerate(c) if x == w], len(c)) for i, c in enumerate(cut) if c for w in set(c) if len(w) < 256)
    for step in (1, 5, 40, 1 << 20):
        monkeypatch.setattr(d, "STEP", step)
        rows = [r for b in d._places(iter([batch.slice(3), batch.slice(0, 3), batch.slice(0, 0)])) for r in b.to_pylist()]
        assert sorted((r["doc_id"], r["word"], r["at"], r["length"]) for r in rows) == want and all(r["n"] == len(r["at"]) for r in rows)


def test_ranked_search_reads_positions_alone(spark, made):
    """Postings hold the length of their field: before, blocks and scores joined them with all lengths."""
    _, scored = d.block_scores(d.Index(spark, made[0]), ["me"], {"text": 1.0})
    assert "n_words" not in scored(spark.createDataFrame([(0,)], "block long"))._jdf.queryExecution().toString()
