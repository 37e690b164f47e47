"""op3's verdicts against fences from exact quantiles of all rows."""

from collections import defaultdict

from textquarry.llm import quality_rules as q

SF = "/root/testdata/sf0.01"
#: Ranks that the sketches' quantiles may be off by: their rank error, and the rank of one row.
OFF = 0.02


def around(values, part):
    """The exact quantile's neighbours within the sketch's error."""
    held = sorted(values)
    at = lambda p: held[min(len(held) - 1, max(0, int(p * len(held))))]
    return at(part - OFF - 1 / len(held)), at(part + OFF + 1 / len(held))


def fence(values, ratio):
    """Ranges that the low and the high fence lie in."""
    low_too, least = q.RATIOS[ratio]
    (a1, b1), (a3, b3) = around(values, 0.25), around(values, 0.75)
    narrow, wide = q.REACH * max(a3 - b1, least), q.REACH * max(b3 - a1, least)
    return (a1 - wide, b1 - narrow) if low_too else (-1.0, -1.0), (a3 + narrow, b3 + wide)


def test_kept_follows_the_exact_fences(spark):
    rows = q.judge(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    good = [r for r in rows if not r.base_failed]
    by_source, by_lang = defaultdict(list), defaultdict(list)
    for r in good:
        by_source[r.lang, r.source].append(r)
        by_lang[r.lang].append(r)
    own = unsure = 0
    for r in rows:
        level = by_source[r.lang, r.source] if len(by_source[r.lang, r.source]) >= q.MIN_ROWS else by_lang[r.lang] if len(by_lang[r.lang]) >= q.MIN_ROWS else good
        own += level is not good
        surely_in, surely_out = True, False
        for ratio in q.RATIOS:
            (low_a, low_b), (high_a, high_b) = fence([x[ratio] for x in level], ratio)
            assert low_a - 1e-9 <= r[f"{ratio}_low"] <= low_b + 1e-9 and high_a - 1e-9 <= r[f"{ratio}_high"] <= high_b + 1e-9
            surely_in &= low_b <= r[ratio] <= high_a
            surely_out |= r[ratio] < low_a or r[ratio] > high_b
        if r.base_failed or surely_out:
            assert not r.kept
        elif surely_in:
            assert r.kept
        else:
            unsure += 1
    assert own > 0.8 * len(rows) and unsure <= 0.02 * len(rows) and any(not r.kept for r in good)


def test_fences_of_few_rows_are_the_corpus_s(spark):
    """A language of fewer than MIN_ROWS rows and a null one take the whole corpus's fences."""
    texts = [(i, " ".join(f"{'ab' if i % 2 else 'abcd'}{i}x{j}" for j in range(60)), ["en", "fr", None][i % 50 % 3 if i % 50 < 3 else 0], "s") for i in range(400)]
    rows = q.judge(spark.createDataFrame(texts, "doc_id long, text string, lang string, source string")).collect()
    few = {r.lang: r.mean_word_high for r in rows if r.lang != "en"}
    assert set(few) == {"fr", None} and few["fr"] == few[None]
    (_, _), (a, b) = fence([r.mean_word for r in rows], "mean_word")
    assert a - 1e-9 <= few["fr"] <= b + 1e-9
