import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from textquarry import Scope, SearchType, build_all, load_index, search
from textquarry.operators.batch import batch_prefix
from textquarry.operators.search import matches
from textquarry.plans import fuzzy, sql
from textquarry.sources.corpus import from_column
from textquarry.streaming import windows


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("most", [1, 2, 3])
def test_fuzzy_against_all_words(spark, tmp_path, most):
    rng = random.Random(most)
    words = sorted({"".join(rng.choices("abé日", k=rng.randrange(0, 9))) for _ in range(400)} | {"a" * 200, "a" * 199 + "b"})
    fuzzy.build_fuzzy(spark.createDataFrame([(w, 2) for w in words], "token string, freq long"), str(tmp_path), most)
    for term in ["", "a", "ab", "abéab", "日日ab日", "a" * 201, "bbbbbbbb"]:
        for far in range(most + 1):
            got = {r.token: r.distance for r in fuzzy.fuzzy_search(spark, str(tmp_path), term, far).collect()}
            assert got == {w: n for w in words if (n := distance(w, term)) <= far}, (term, far)
    plan = fuzzy.fuzzy_search(spark, str(tmp_path), "abéab", 1)._jdf.queryExecution().toString()
    assert "PushedFilters: [Or(" in plan or "EqualTo(size" in plan
    with pytest.raises(ValueError):
        fuzzy.fuzzy_search(spark, str(tmp_path), "a", most + 1)


def test_batch_is_single_searches(spark):
    rng = random.Random(8)
    corpus = from_column(spark.createDataFrame([(" ".join("".join(rng.choices("abc", k=rng.randrange(1, 6))) for _ in range(300)),)], "t string"), "t")
    terms = ["a", "ab", "abc", "ccccc", "zz", "b"]
    table = spark.createDataFrame([(t,) for t in [*terms, "a", "", None]], "term string")
    from textquarry.operators.tokens import counted, tokens

    got = sorted(tuple(r) for r in batch_prefix(counted(tokens(corpus, Scope.WORD)), table, 9).collect())
    assert got == sorted((t, r.priority, r.token) for t in terms for r in search(corpus, Scope.WORD, SearchType.PREFIX, t, k=9).collect())
    plan = batch_prefix(counted(tokens(corpus, Scope.WORD)), table, 9)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert batch_prefix(counted(tokens(corpus, Scope.WORD)), table.where("false"), 9).count() == 0


def test_table_function_is_the_search(spark, tmp_path):
    rng = random.Random(6)
    texts = ["".join(rng.choice(["a", "b ", "ab ", "the ", ".", "\n", "The "]) for _ in range(60)) for _ in range(40)]
    build_all(from_column(spark.createDataFrame([(t,) for t in texts], "t string"), "t"), str(tmp_path))
    index = load_index(spark, str(tmp_path))
    sql.register(spark, index)
    for scope in Scope:
        for kind in SearchType:
            for term in ("a", "the", "ab the", ""):
                got = spark.sql("SELECT token, freq FROM text_search(:scope, :kind, :term)", args={"scope": scope.value, "kind": kind.value, "term": term})
                want = matches(index, scope, kind, term, "extended")
                assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in want.collect()), (scope, kind, term)
    plan = spark.sql("SELECT * FROM text_search('word', 'suffix', 'he')")._jdf.queryExecution().toString().split("Physical Plan")[1]
    assert "StringStartsWith(token_rev,eh)" in plan and plan.count("FileScan") == 1


def test_late_rows(spark, tmp_path):
    """A row behind the watermark is dropped, one within the delay counts, and restarts write nothing twice."""
    t0 = datetime(2024, 1, 1)
    put = lambda name, rows: spark.createDataFrame([(t0 + timedelta(minutes=m), k, v) for m, k, v in rows], "ts timestamp, k string, v int").select("ts", "k", F.col("v").cast("decimal(9,2)").alias("v")).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/in/{name}")
    put("a", [(1, "x", 1), (5, "x", 1), (61, "y", 1), (95, "x", 1)])

    def run():
        stream = spark.readStream.schema("ts timestamp, k string, v decimal(9,2)").parquet(f"{tmp_path}/in/*")
        out = {}
        for name, counts in (("t", windows.tumbling(stream, "k", "v", "1 hour", "30 minutes")), ("s", windows.sessions(stream, "k", "v", "10 minutes", "30 minutes"))):
            windows.start(counts, f"{tmp_path}/{name}", f"{tmp_path}/ck-{name}").awaitTermination()
            out[name] = sorted((r.key, int((r.start - t0).seconds / 60), int((r.end - t0).seconds / 60), r.n) for r in windows.closed(spark, counts, f"{tmp_path}/{name}").collect())
        return out

    first = run()
    assert first["t"] == [("x", 0, 60, 2)] and first["s"] == [("x", 1, 15, 2)]
    assert run() == first
    # The watermark stands at 65 minutes: 59 is late, 70 is not.
    put("b", [(59, "x", 1), (70, "x", 1), (200, "y", 1)])
    assert run()["t"] == [("x", 0, 60, 2), ("x", 60, 120, 2), ("y", 60, 120, 1)]


def test_fuzzy_index_is_not_sampled(spark, tmp_path, monkeypatch):
    """Rows stay where their words are: before, three rows a word were sampled and dealt by ranges."""

    def no_ranges(*_):
        raise AssertionError("ranges are sampled")

    monkeypatch.setattr(type(spark.range(1)), "repartitionByRange", no_ranges)
    fuzzy.build_fuzzy(spark.createDataFrame([("metal", 1), ("petal", 2), ("me", 1)], "token string, freq long"), str(tmp_path))
    assert sorted(r.token for r in fuzzy.fuzzy_search(spark, str(tmp_path), "metal", 1).collect()) == ["metal", "petal"]
