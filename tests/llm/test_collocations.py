import random
import re
from collections import Counter, defaultdict

import pytest
from oracle import connection, rows_of, sql_rows
from textquarry.llm import collocations
from textquarry.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, phrase string, n long, a long, w string"


def brute(rows, max_n, min_count, share, top):
    counts, words = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = lang or "und"
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            for k in range(1, max_n + 1):
                for i in range(len(w) - k + 1):
                    counts[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        held = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cand.items()):
                continue
            score, _, left, right = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            held.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(held)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, words[lang], -score))
    return sorted(out)


def found(spark, rows, **kw):
    docs = spark.createDataFrame([(i, t, g, "x", 1, 2, "y") for i, (t, g) in enumerate(rows)], DOCS)
    return sorted(tuple(r) for r in collocations.collocations(docs, **kw).collect())


@pytest.mark.parametrize("min_count,share,top,max_n", [(2, 80, 2000, 4), (3, 50, 7, 4), (2, 100, 5, 3), (4, 80, 2000, 5)])
def test_against_brute_force(spark, min_count, share, top, max_n):
    rng = random.Random(min_count)
    texts = [("".join(rng.choice(["a", "B", "é", "dd", " ", " ", "\t", ".", "\n", "  ", "日"]) for _ in range(rng.randrange(60))), rng.choice(["en", "de", None])) for _ in range(150)]
    rows = [*texts, *texts[:20], (None, "en"), ("", None), (" ,;\t\n", "fr"), ("one two three four " * 40, "en"), (" ".join(f"w{i % 50}" for i in range(20_000)), "de")]
    assert found(spark, rows, max_n=max_n, min_count=min_count, share=share, top=top) == brute(rows, max_n, min_count, share, top)


def test_filter_that_is_full(spark):
    """With nearly every bit set the bitmap lets wrong rows through, and the counts drop them."""
    rows = [("a b c d a b c x y z", "en")] * 3 + [("q r s t u v", "en")]
    assert found(spark, rows, min_count=3, filter_bits=64) == brute(rows, 4, 3, 80, 2000)


def test_texts_never_join(spark):
    rows = [("a", "en"), ("b", "en")] * 5 + [(None, "en"), ("", "en")] * 2
    assert found(spark, rows, min_count=2) == []
    assert found(spark, [], min_count=2) == []


def test_words_of_runs(spark, monkeypatch):
    monkeypatch.setattr(collocations, "BATCH_BYTES", 7)
    rows = [("ab cd, ef gh", "en"), ("ab cd ef", "en"), (" ab cd", None), ("ab cd", None)]
    assert found(spark, rows, min_count=2) == brute(rows, 4, 2, 80, 2000)


def test_score_past_64_bits(spark):
    big = 9_000_000_000_000_000_000
    rows = spark.createDataFrame([("en", 1, "a", big), ("en", 1, "b", big), ("en", 2, "a b", big - 1), ("en", 1, "c", 40), ("en", 3, "a b c", 40), ("en", 2, "b c", 40)], "lang string, n_words int, phrase string, a long")
    got = {r.phrase: r.score for r in collocations.scored(rows).collect()}
    assert got["a b"] == 2_000_000 * (big - 1) // (2 * big)
    assert {r.phrase for r in collocations.unextended(collocations.scored(rows)).collect()} == {"a b", "a b c"}


def test_query(spark):
    sql = sql_rows(connection(SF), oracle_sql()["op13_collocations"])
    assert rows_of(queries()["op13_collocations"](spark, SF)) == sql and sql
