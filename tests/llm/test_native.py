import hashlib
import itertools
import re
import zlib
from collections import Counter

import pytest

from oracle import connection, rows_of, sql_rows
from textquarry.llm import decontamination, quality_rules, sharding
from textquarry.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, h int, place int, w string"
LONG = " ".join(f"w{i % 700}" for i in range(20_000))
ROWS = [
    (1, None, None, None, 0, 1, 2, "x"),
    (2, "", "en", None, 0, 1, 2, "x"),
    (3, "a b c a b c\nx\n\nx\n \n \n", "en", "s", 0, 1, 2, "x"),
    (3, "a b c a b c\nx\n\nx\n \n \n", "en", "s", 0, 1, 2, "x"),
    (None, "One two three four five six seven eight nine ten eleven", None, "s", 0, 1, 2, "x"),
    (5, LONG, "de", "s", 0, 1, 2, "x"),
    (6, "aa aa aa aa aa # $x| é日本", "en", "s", 0, 1, 2, "x"),
    (3, "other text one two three", "en", "s", 0, 1, 2, "x"),
]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORD.findall(text or "")
    grams = list(zip(words, words[1:], words[2:], strict=False))
    often = Counter(grams)
    hit = {i + j for i, g in enumerate(grams) if often[g] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), failed


COLS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_quality_edges(spark):
    got = quality_rules.judge(spark.createDataFrame(ROWS, DOCS)).collect()
    assert sorted(((r.doc_id or 0), *(r[c] for c in COLS)) for r in got) == sorted((r[0] or 0, *base(r[1])) for r in ROWS)
    assert not any(r.kept for r in got if r.base_failed)
    assert quality_rules.judge(spark.createDataFrame([], DOCS)).count() == 0


def test_quality_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries()["op3_quality_rules"](spark, SF).collect()
    assert {r.doc_id: tuple(r[c] for c in COLS) for r in got} == {k: base(t) for k, t in docs.items()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [r for r in got if labels.get(r.doc_id) == 1 and not r.base_failed]
    assert sum(r.kept for r in good) >= 0.98 * len(good)


def test_fences_follow_the_group(spark):
    rows = [(i, " ".join(f"{'ab' if i < 150 else 'abcdefgh'}{i}x{j}" for j in range(60)), "en" if i < 150 else "de", "s", 0, 0, 0, "") for i in range(300)]
    rows.append((999, " ".join(f"{'z' * 60}{j}" for j in range(60)), "en", "s", 0, 0, 0, ""))
    rows.append((998, "### " + " ".join(f"ab#{j}#" for j in range(60)), "en", "tiny", 0, 0, 0, ""))
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, DOCS)).collect()}
    assert [k for k, r in got.items() if not r.kept] and {k for k, r in got.items() if not r.kept} == {998, 999}
    assert got[0].mean_word_high < got[200].mean_word_high


NORM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def normal(text):
    return NORM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def contaminated(text, items):
    w = normal(text)
    hit, found = set(), set()
    for item, t in items:
        v = normal(t)
        k = min(10, len(v))
        wins = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if v else set()
        for i in range(len(w) - k + 1):
            if tuple(w[i : i + k]) in wins:
                hit.update(range(i, i + k))
                found.add(str(item))
    ids = ",".join(sorted(found))
    return len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)


ITEMS = [(1, "ONE two, three four five six seven eight nine ten eleven twelve"), (10, "two-three FOUR"), (2, "aa aa"), (7, None), (8, " . "), (11, "two three four"), (3, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10")]


@pytest.mark.parametrize("limit", [10**8, -1])
def test_decontamination_edges(spark, limit, monkeypatch):
    monkeypatch.setattr(decontamination, "MAX_BROADCAST_BYTES", limit)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = spark.createDataFrame(ROWS, DOCS)
    got = [((r.doc_id or 0), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontamination.report(docs, bench).collect()]
    assert sorted(got) == sorted((r[0] or 0, *contaminated(r[1], ITEMS)) for r in ROWS)
    kept = decontamination.remove(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == sorted(r[0] or 0 for r in ROWS if not contaminated(r[1], ITEMS)[4])
    cut = {(r.doc_id, r.text) for r in decontamination.clean(docs, bench).collect()}
    assert (3, "other text one two three") in cut and (None, "") in cut and (6, " # $x| é日本") in cut and (1, None) in cut
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in decontamination.report(docs, none).collect())
    assert decontamination.report(spark.createDataFrame([], DOCS), bench).count() == 0


def test_decontamination_query(spark):
    got = rows_of(queries()["op4_decontamination"](spark, SF))
    assert got == sql_rows(connection(SF), oracle_sql()["op4_decontamination"])
    assert any(r[0] for r in got)


def best_by_force(sizes, n):
    return min(max(sum(sizes[a:b]) for a, b in itertools.pairwise((0, *c, len(sizes)))) for c in itertools.combinations_with_replacement(range(len(sizes) + 1), n - 1))


@pytest.mark.parametrize("sizes", [[], [5], [1, 2, 3, 4, 5, 6], [9, 1, 1, 1, 1, 1], [1, 1, 1, 30, 1, 1], [3] * 7])
@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_minimax(sizes, n):
    least = best_by_force(sizes, n) if sizes else 0
    assert sharding.least_capacity(sizes, n) == least
    at = sharding.cuts(sizes, n)
    assert at[0] == 0 and at[-1] == len(sizes) and at == sorted(at) and len(at) == n + 1
    assert max(sum(sizes[a:b]) for a, b in itertools.pairwise(at)) == least


def check_shards(rows, texts, n=16):
    by_text, slots = {}, {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    for shard, s in slots.items():
        assert 0 <= shard < n and sorted(s) == list(range(len(s)))
    for doc, text in texts:
        data = (text or "").encode()
        r = next(r for r in rows if r.doc_id == doc and r.text_crc32 == zlib.crc32(data) and r.size == len(data) + 1)
        assert by_text.setdefault(text or "", r.shard) == r.shard


def test_sharding(spark, monkeypatch):
    rows = queries()["op8_sharding"](spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    check_shards(rows, [(r.doc_id, r.text) for r in docs])
    total = Counter()
    for r in rows:
        total[r.shard] += r.size
    assert len(rows) == len(docs) and max(total.values()) <= sum(total.values()) / 16 + max(r.size for r in rows)
    monkeypatch.setattr(sharding, "SPLIT_ROWS", 3)
    some = [*ROWS, *[(100 + i, "hot", "en", "s", 0, 1, 2, "x") for i in range(50)]]
    got = sharding.assign(spark.createDataFrame(some, DOCS), 4).collect()
    assert len(got) == len(some)
    check_shards(got, [(r[0], r[1]) for r in some], 4)
    assert sharding.assign(spark.createDataFrame([], DOCS), 4).count() == 0


@pytest.mark.parametrize("bits,n", [(2, 4), (2, 7), (16, 4), (1, 3)])
def test_least_capacity_over_single_groups(spark, monkeypatch, bits, n):
    """However coarse the places are, no order of whole groups could be cut into smaller shards."""
    monkeypatch.setattr(sharding, "STEP_BITS", bits)
    monkeypatch.setattr(sharding, "PLACES", 1 << bits)
    texts = [f"text {i} " * (1 + i * i % 37) for i in range(90)] + ["hot " * 40] * 25 + [None, "", ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    groups = docs.selectExpr("xxhash64(coalesce(text, '')) AS h", "octet_length(coalesce(text, '')) + 1 AS n").groupBy("h").agg({"n": "sum"}).orderBy("h").collect()
    rows = sharding.assign(docs, n).collect()
    total = Counter()
    for r in rows:
        total[r.shard] += r.size
    assert max(total.values()) == sharding.least_capacity([g[1] for g in groups], n) and len(rows) == len(texts)
    check_shards(rows, list(enumerate(texts)), n)
