import random
from collections import Counter

import pytest

from textquarry import Scope, SearchType, load_index, search
from textquarry.plans import store
from textquarry.sources import files
from textquarry.sources.shared import shared_dir

WORDS = ["me", "met", "metal", "some", "home", "the", "time"]
P, S, C = SearchType.PREFIX, SearchType.SUFFIX, SearchType.CONTAINS


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def counts(spark, root, number=None, scope=Scope.WORD):
    index = load_index(spark, root, number)
    each = [{r.token: r.freq for r in index[scope, kind].collect()} for kind in SearchType]
    assert each[0] == each[1] == each[2]
    return each[0]


def words(rows):
    return dict(Counter(w for _, t in rows for w in t.replace("\n", " ").split()))


def lines(rows):
    return dict(Counter(x for _, t in rows for x in t.split("\n")))


def test_random_changes(spark, tmp_path):
    """Appends and deletes in any order against a plain list of rows; every version stays what it was."""
    rng, root, alive, before, n = random.Random(1), str(tmp_path), [], {}, 0
    for step in range(7):
        if step in (0, 1, 3, 5):
            new = [(rng.choice([None, *range(12)]), "\n".join(" ".join(rng.choices(WORDS, k=3)) for _ in range(2))) for _ in range(6)]
            store.append(docs(spark, new), root)
            alive = alive + new
        elif step == 6:
            store.compact(spark, root)
        else:
            gone = rng.sample(range(14), 5)
            store.delete(spark.createDataFrame([(g,) for g in [*gone, None, gone[0]]], "doc_id long"), root)
            alive = [r for r in alive if r[0] not in gone]
        n = store.version(spark, root).number
        before[n] = list(alive)
        assert counts(spark, root) == words(alive) and counts(spark, root, scope=Scope.LINE) == lines(alive), step
    for number, rows in before.items():
        assert counts(spark, root, number) == words(rows)
    last = store.version(spark, root)
    assert len(last.segments) == 1 and not last.deletes
    store.vacuum(spark, root)
    assert store.versions(spark, root) == [n] and counts(spark, root) == words(alive)
    assert files.names(spark, f"{root}/segments") == [last.segments[0].name] and files.names(spark, f"{root}/deletes") == []


def test_append_that_fails_half_way(spark, tmp_path, monkeypatch):
    root, first, more = str(tmp_path), [(1, "me met")], [(2, "met home\nthe me")]
    store.append(docs(spark, first), root, source="s", batch=0)
    real, left = store.write_kinds, [1]

    def failing(items, scope, path_of):
        if scope is Scope.LINE and left:
            left.pop()
            real(items.limit(1), scope, path_of)
            raise OSError("a full disk")
        real(items, scope, path_of)

    monkeypatch.setattr(store, "write_kinds", failing)
    with pytest.raises(OSError):
        store.append(docs(spark, more), root, source="s", batch=1)
    assert counts(spark, root) == words(first) and store.version(spark, root).number == 0
    for _ in range(3):  # done again, and then twice too often
        store.append(docs(spark, more), root, source="s", batch=1)
    assert counts(spark, root) == words(first + more) and counts(spark, root, scope=Scope.LINE) == lines(first + more)
    assert store.version(spark, root).number == 1


def test_writers_at_once(spark, tmp_path, monkeypatch):
    """Another writer commits between a delete's reading and its commit: the delete counts anew."""
    root = str(tmp_path)
    store.append(docs(spark, [(1, "me"), (2, "me met"), (3, "home")]), root)
    real, once = store._commit, [1]

    def late(spark_, root_, base, kind, *rest):
        if kind == "delete" and once:
            once.pop()
            store.delete(spark.createDataFrame([(2,)], "doc_id long"), root)
        return real(spark_, root_, base, kind, *rest)

    monkeypatch.setattr(store, "_commit", late)
    store.delete(spark.createDataFrame([(1,), (2,)], "doc_id long"), root)
    assert counts(spark, root) == {"home": 1}
    assert not files.create_once(spark, f"{root}/versions/0000000000.json", "x")
    with monkeypatch.context() as m:
        m.setattr(store, "_commit", lambda *a: None)
        with pytest.raises(store.ConcurrentCommit):
            store.compact(spark, root)
    assert counts(spark, root) == {"home": 1}


def test_writers_during_a_compaction(spark, tmp_path, monkeypatch):
    """What was added and deleted while segments were merged stands beside the merged one; a build in between stops it."""
    root = str(tmp_path)
    store.append(docs(spark, [(1, "me"), (2, "met met"), (3, "home")]), root)
    store.delete(spark.createDataFrame([(1,)], "doc_id long"), root)
    real, between = store.Items.rewrite, [lambda: (store.append(docs(spark, [(1, "so"), (4, "met")]), root), store.delete(spark.createDataFrame([(3,), (4,)], "doc_id long"), root))]

    def slow(self, *args):
        real(self, *args)
        between.pop()()

    monkeypatch.setattr(store.Items, "rewrite", slow)
    store.compact(spark, root)
    held = store.version(spark, root)
    assert held.kind == "compact" and len(held.segments) == 3 and len(held.deletes) == 1
    assert counts(spark, root) == {"met": 2, "so": 1}
    between.append(lambda: store.build(docs(spark, [(9, "new")]), root))
    with pytest.raises(store.ConcurrentCommit):
        store.compact(spark, root)
    assert counts(spark, root) == {"new": 1}
    monkeypatch.undo()
    store.delete(spark.createDataFrame([(9,)], "doc_id long"), root)
    store.compact(spark, root)
    assert counts(spark, root) == {}
    said = store.history(spark, root).orderBy("number").collect()
    assert [r.kind for r in said] == ["append", "delete", "append", "delete", "compact", "build", "delete", "compact"]
    assert store.as_of(spark, root, said[5].at) == 5 and store.as_of(spark, root, "2999") == 7
    with pytest.raises(ValueError):
        store.as_of(spark, root, "1999")


def test_id_that_comes_again(spark, tmp_path):
    root = str(tmp_path)
    store.append(docs(spark, [(1, "me"), (2, "met")]), root)
    store.delete(spark.createDataFrame([(1,), (99,)], "doc_id long"), root)
    store.append(docs(spark, [(1, "home")]), root)
    assert counts(spark, root) == {"met": 1, "home": 1}
    store.compact(spark, root)
    assert counts(spark, root) == {"met": 1, "home": 1}


def test_pushdown_through_merging(spark, tmp_path):
    root = str(tmp_path)
    for k in range(3):
        store.append(docs(spark, [(k, "metal some")]), root)
    store.delete(spark.createDataFrame([(0,)], "doc_id long"), root)
    for kind, term, want in ((P, "me", "StringStartsWith(token,me)"), (S, "al", "StringStartsWith(token_rev,la)")):
        found = search(load_index(spark, root), Scope.WORD, kind, term)
        assert want in found._jdf.queryExecution().toString()
        assert [tuple(r) for r in found.collect()] == [(3, "metal")] * 2


def test_lost_dataset_and_no_index(spark, tmp_path):
    root = str(tmp_path / "a")
    store.build(docs(spark, [(1, "me met")]), root)
    name = store.version(spark, root).segments[0].name
    files.remove(spark, store.dataset(root, name, Scope.WORD, "trie"))
    index = load_index(spark, root, strict=False)
    assert search(index, Scope.WORD, P, "me").count() == 0 and search(index, Scope.WORD, S, "t").count() == 1
    with pytest.raises(FileNotFoundError):
        load_index(spark, str(tmp_path / "none"))
    assert load_index(spark, str(tmp_path / "none"), strict=False)[Scope.WORD, S].count() == 0
    with pytest.raises(ValueError):
        load_index(spark, root, version=7)


class Session:
    """A session whose shared folder is written without a scheme."""

    def __init__(self, spark, place):
        self.sparkContext, self._jvm, self._jsc = spark.sparkContext, spark._jvm, spark._jsc
        self.conf = type("Conf", (), {"get": lambda _, key, default=None: place})()


def test_shared_folder_has_a_scheme(spark, tmp_path):
    shared_dir(spark)  # so that the session has its folder already
    assert shared_dir(Session(spark, f"{tmp_path}/")) == f"file:{tmp_path}"
    held = spark._jsc.hadoopConfiguration()
    held.set("fs.viewfs.mounttable.store.link./x", f"file://{tmp_path}")
    held.set("fs.defaultFS", "viewfs://store/")
    try:
        assert shared_dir(Session(spark, "/x/y")) == "viewfs://store/x/y"
    finally:
        held.set("fs.defaultFS", "file:///")


def _size(place):
    return sum(p.stat().st_size for p in place.rglob("*.parquet"))


def test_index_is_small(spark, tmp_path):
    """Lines stand once in each order, without their words, and texts once: it was eight times as much."""
    rng = random.Random(3)
    rows = [(i, "\n".join(" ".join(f"{rng.randrange(10**6):06d}" for _ in range(12)) for _ in range(10))) for i in range(400)]
    docs(spark, rows).coalesce(1).write.option("compression", "zstd").parquet(str(tmp_path / "in"))
    store.build(spark.read.parquet(str(tmp_path / "in")), str(tmp_path / "index"))
    held = next((tmp_path / "index" / "segments").iterdir())
    assert _size(held / "scope=line") < 3 * _size(tmp_path / "in") and _size(held / "type=texts") < 2 * _size(tmp_path / "in")


def test_line_search_shuffles_matches_only(spark, tmp_path):
    """A line's test passes the merging of segments; it read the stored words, which kept it above and moved every line."""
    root = str(tmp_path)
    for k in range(3):
        store.append(docs(spark, [(k, "so the home\nme met"), (k + 10, "or the time")]), root)
    store.delete(spark.createDataFrame([(0,), (10,)], "doc_id long"), root)
    found = search(load_index(spark, root), Scope.LINE, C, "the")
    assert [tuple(r) for r in found.collect()] == [(8, "or the time"), (8, "so the home")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("Aggregate") < plan.index("slice(")


def test_texts_of_both_rules(spark, tmp_path):
    """Deletes and compactions cut a text as it was cut when it came in."""
    root, text = str(tmp_path), "日本語 me"
    store.append(docs(spark, [(1, text)]), root, store.Items(any_script=True))
    store.append(docs(spark, [(2, text), (3, "me")]), root)
    store.compact(spark, root)
    store.delete(spark.createDataFrame([(1,)], "doc_id long"), root)
    assert counts(spark, root) == {"日本語": 1, "me": 2}
    store.delete(spark.createDataFrame([(2,)], "doc_id long"), root)
    store.compact(spark, root)
    assert counts(spark, root) == {"me": 1}
    assert search(load_index(spark, root), Scope.LINE, P, "m").count() == 0
