import itertools
import random
import re

import pytest

from oracle import connection, rows_of, sql_rows
from textquarry.llm import jaccard_join, storage
from textquarry.llm.components import components
from textquarry.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, cls long, n long, grp string, token string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """(doc_id, n, component) by comparing all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if rows[a][0] is None or rows[b][0] is None or not sets[a] or not sets[b]:
            continue
        both = len(sets[a] & sets[b])
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            parent[root(a)] = root(b)
    least = {}
    for k, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(k)] = min(doc, least.get(root(k), doc))
    return sorted((-1 if d is None else d, len(sets[k]), -1 if d is None else least[root(k)]) for k, (d, _) in enumerate(rows))


def found(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in df.collect())


def fixture(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(3))
    boiler = [word() for _ in range(30)]
    rows = [(None, "one two three four five six"), (900, None), (901, ""), (902, " \t\n"), (903, "Few words"), (904, "few\nWORDS"), (905, "few")]
    for cluster in range(12):
        base = [word() for _ in range(rng.choice([12, 40, 90]))]
        if cluster % 3 == 0:
            base[:0] = boiler
        for _ in range(rng.choice([1, 3, 9])):
            text = list(base)
            for _ in range(rng.randrange(4)):
                text[rng.randrange(len(text))] = word()
            if rng.random() < 0.3:
                text = text[: rng.randrange(len(text) * 3 // 4, len(text) + 1)]
            rows.append((len(rows), " ".join(text)))
    rows += [(800 + k, " ".join([*boiler, *(word() for _ in range(12))])) for k in range(12)]  # similar, but below the limit
    rows += [(700 + k, rows[10][1].upper()) for k in range(5)] + [rows[12], rows[12]]
    return rows


@pytest.mark.parametrize("settings", [{}, {"SHARE": 0, "PIVOTS": 0}, {"SHARE": 1, "PIVOTS": 0}, {"PIVOTS": 0, "BATCH_BYTES": 300, "SMALL_GROUP": 0, "UNION_ROW": 20}, {"MAX_GROUPS": 1, "PIVOTS": 0, "BLOCK": 8}, {"MAX_BROADCAST_BYTES": 0, "MAX_GROUPS": 2}])
def test_random_texts(spark, monkeypatch, settings):
    for k, v in settings.items():
        monkeypatch.setattr(storage if k == "MAX_BROADCAST_BYTES" else jaccard_join, k, v)
    rows = fixture(5)
    docs = spark.createDataFrame([(*r, 1, 2, "x", "y") for r in rows], SCHEMA).repartition(3)
    assert found(jaccard_join.join(docs)) == brute(rows)


def test_texts_of_common_passages(spark, monkeypatch):
    """Texts put together from a few passages: every shingle is frequent, and links hang on tokens of many groups."""
    monkeypatch.setattr(jaccard_join, "MAX_GROUPS", 3)
    monkeypatch.setattr(jaccard_join, "PIVOTS", 0)
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    passages = [" ".join(word() for _ in range(20)) for _ in range(6)]
    rows = []
    for k in range(120):
        some = rng.sample(passages, rng.choice([1, 2, 3, 4]))
        some.insert(rng.randrange(len(some) + 1), " ".join(word() for _ in range(rng.randrange(12))))
        rows.append((k, " ".join(some)))
    want = brute(rows)
    assert found(jaccard_join.join(spark.createDataFrame([(*r, 1, 2, "x", "y") for r in rows], SCHEMA).repartition(3))) == want
    assert len({w[2] for w in want}) < 120


@pytest.mark.parametrize("pivots,sf", [(0, None), (1, "/root/testdata/sf0.01")])
def test_links_between_groups_come_through_the_bound(spark, monkeypatch, pivots, sf):
    """Candidates are asked for their bound, those that qualify are opened, and every link between groups is of an opened one."""
    monkeypatch.setattr(jaccard_join, "PIVOTS", pivots)
    bound, compare, seen, compared = jaccard_join._opened, jaccard_join._linked, {}, []

    def opened(candidates, sets, grouped):
        out = bound(candidates, sets, grouped)
        seen.update(asked=candidates.count(), opened={(r.cls, r.grp) for r in out.collect()}, group={r.cls: r.grp for r in grouped.collect()})
        return out

    def linked(pairs, sets):
        out = storage.written(compare(pairs, sets), "spied")
        compared.append({(r.a, r.b) for r in out.collect()})
        return out

    monkeypatch.setattr(jaccard_join, "_opened", opened)
    monkeypatch.setattr(jaccard_join, "_linked", linked)
    rows = fixture(5)
    docs = spark.read.parquet(f"{sf}/documents.parquet") if sf else spark.createDataFrame([(*r, 1, 2, "x", "y") for r in rows], SCHEMA).repartition(3)
    got = found(jaccard_join.join(docs))
    assert got == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()] if sf else rows)
    far = compared[-1]
    assert far and len(compared) == 2 and 0 < len(seen["opened"]) <= seen["asked"]
    assert all((a, seen["group"][b]) in seen["opened"] for a, b in far)


def test_empty_and_long(spark):
    assert jaccard_join.join(spark.createDataFrame([], SCHEMA)).count() == 0
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, long), (2, long + " more"), (3, "x" * 100_000)]
    docs = spark.createDataFrame([(*r, 1, 2, "x", "y") for r in rows], SCHEMA)
    assert found(jaccard_join.join(docs)) == [(1, 29996, 1), (2, 29997, 1), (3, 1, 3)]


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 50)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(2, 41)) and all(got[i] == 100 for i in range(101, 150))
    for a, b in edges:
        assert got.get(a, a) == got.get(b, b)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    query = queries()["op10_jaccard_join"](spark, SF)
    assert found(query) == brute(docs)
    assert rows_of(query) == sql_rows(connection(SF), oracle_sql()["op10_jaccard_join"])


def test_signatures_differ_in_no_more_places_than_sets():
    import numpy as np

    draw = np.random.default_rng(3)
    for size in (0, 1, 40, 900, 5000):
        pool = np.unique(draw.integers(0, 2**63, size, dtype=np.uint64))
        a, b = pool[draw.random(len(pool)) < 0.8], pool[draw.random(len(pool)) < 0.8]
        one, two = (np.array(jaccard_join.signature(s), np.int64).view(np.uint8) for s in (a, b))
        assert len(one) * 8 == jaccard_join.SIGNATURE_BITS
        assert np.unpackbits(one ^ two).sum() <= len(np.setxor1d(a, b))
        assert (one == np.array(jaccard_join.signature(a[::-1].copy()), np.int64).view(np.uint8)).all()
