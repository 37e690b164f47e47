import random

import pytest

from textquarry import Mode, Scope, SearchType, append_index, build_all, load_index, search
from textquarry.functions.uax29 import segment
from textquarry.operators.search import count_matches
from textquarry.operators.tokens import tokens
from textquarry.plans.index import build_postings, compact, lookup_postings, search_postings
from textquarry.plans.queries import queries
from textquarry.sources.corpus import from_column, read_text
from textquarry.streaming.append import load_stream_index, start_indexing, stream_texts

L1, L2 = "hey there lads \\n", "or for me what there is "
P, S, C = SearchType.PREFIX, SearchType.SUFFIX, SearchType.CONTAINS
GOLDEN = [
    ("word", P, "th", [(3, "there"), (3, "there")]),
    ("word", P, "me", []),
    ("word", P, "w", [(3, "what")]),
    ("word", S, "re", [(3, "there"), (3, "there")]),
    ("word", S, "r", [(1, "or"), (2, "for")]),
    ("word", C, "e", [(2, "hey")]),
    ("word", C, "he", [(3, "there")]),
    ("word", C, "ha", [(2, "what")]),
    ("word", C, "her", []),
    ("line", P, "hey", [(14, L1)]),
    ("line", P, "he", []),
    ("line", P, "or", [(22, L2)]),
    ("line", S, "is", []),
    ("line", C, "me", [(22, L2)]),
    ("line", C, "there", [(12, L1), (19, L2)]),
    ("line", C, "for me", [(18, L2)]),
    ("line", C, "or for", []),
    ("line", C, "hey", []),
    ("line", C, "for me what", []),
]


def corpus(spark, *texts):
    return from_column(spark.createDataFrame([(t,) for t in texts], "t string"), "t")


def found(source, scope, kind, term, **kw):
    return [tuple(r) for r in search(source, Scope(scope), kind, term, **kw).collect()]


@pytest.fixture(scope="module")
def indexes(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("index"))
    build_all(corpus(spark, f"{L1}\n{L2}"), root)
    return load_index(spark, root)


@pytest.mark.parametrize("scope,kind,term,expected", GOLDEN)
def test_golden(spark, indexes, scope, kind, term, expected):
    assert found(corpus(spark, f"{L1}\n{L2}"), scope, kind, term) == expected
    assert found(indexes, scope, kind, term) == expected


@pytest.mark.parametrize(
    "scope,kind,term,text,expected",
    [
        ("word", P, "me", "Metal metal", [(3, "metal")]),
        ("word", C, "e", "ememe", []),
        ("word", C, "me", "xméy", []),
        ("word", C, "é", "xéy", []),
        ("line", C, "me", "a me.", []),
        ("line", C, "me", "Me and me too", []),
        ("line", C, "me", "mean to me you", []),
        ("line", P, "a", "---", []),
        ("word", P, "", "b a", [(1, "a"), (1, "b")]),
        ("line", P, "", "b a", []),
        ("word", C, "", "b a", []),
        ("line", S, "b c", "a b c", []),
        ("line", C, " me", "a b me c", []),
        ("line", C, "me", "is it so me--THE end", [(18, "is it so me--THE end")]),
    ],
)
def test_edges(spark, scope, kind, term, text, expected):
    assert found(corpus(spark, text), scope, kind, term) == expected


def test_score_wraps(spark):
    line = "a b me " + "x" * 251
    assert found(corpus(spark, line), "line", C, "me") == [(0, line)]


def test_extended(spark):
    assert found(corpus(spark, "there"), "word", C, "her", mode=Mode.EXTENDED) == [(2, "there")]
    assert found(corpus(spark, "Meta3"), "word", P, "Me", mode=Mode.EXTENDED) == [(3, "Meta3")]
    assert found(corpus(spark, "a b c d e"), "line", C, "b c d", mode=Mode.EXTENDED) == [(4, "a b c d e")]


@pytest.mark.parametrize("term", ["Me", "m3"])
def test_compat_terms(spark, term):
    with pytest.raises(ValueError):
        search(corpus(spark, "x"), Scope.WORD, P, term)


def test_lines_and_size_guard(spark):
    got = [r.token for r in tokens(corpus(spark, "a\r\nb\rc\n\nd\n"), Scope.LINE).collect()]
    assert got == ["a", "b\rc", "", "d"]
    assert tokens(corpus(spark, "a" * 256 + " b"), Scope.WORD).count() == 1
    assert tokens(corpus(spark, "a" * 32769 + "\nb"), Scope.LINE).count() == 1
    assert tokens(corpus(spark, "", None), Scope.LINE).count() == 0


@pytest.mark.parametrize("unit", ["a", "a1", "a.", "1,"])
def test_long_token(spark, unit):
    from pyspark.sql import functions as F

    from textquarry.functions.tokenize import words

    n = corpus(spark, unit * 500_000).select(F.size(words(F.col("text")))).first()[0]
    assert n == 1


def test_other_scripts(spark):
    assert segment("日本 ok") == ["日", "本", "ok"]
    got = [r.token for r in tokens(corpus(spark, "日本 it's 3.5", "plain, text"), Scope.WORD, any_script=True).collect()]
    assert sorted(got) == sorted(["日", "本", "it's", "3.5", "plain", "text"])


def test_empty_and_null(spark):
    empty = corpus(spark).where("false") if False else from_column(spark.createDataFrame([], "t string"), "t")
    for scope in Scope:
        for kind in SearchType:
            assert found(empty, scope, kind, "me") == []
            assert count_matches(empty, scope, kind, "me").first()[0] == 0


def model(texts, scope, kind, term):
    """A plain model: cut, test, score, sort."""
    import regex

    sep = regex.compile(r"(?:\p{L}[\p{L}\p{M}]*(?:[:.'’]\p{L}[\p{L}\p{M}]*)*|\p{Nd}+(?:[,;.'’]\p{Nd}+)*|\p{Pc}+)+")
    cut = lambda t: [w for w in sep.findall(t) if regex.search(r"[\p{L}\p{N}]", w)]
    items = [x for t in texts for x in (cut(t) if scope == "word" else t.split("\n")[: -1 if t.endswith("\n") else None] if t else [])]
    out = []
    for x in items:
        w = cut(x)
        if kind is P and x.startswith(term) and x != term and (scope == "word" or w and w[0].lower() == term):
            out.append(x)
        if kind is S and x.endswith(term) and x != term and (scope == "word" or w and w[-1].lower() == term):
            out.append(x)
        if kind is C and term in x and not x.startswith(term) and not x.endswith(term):
            if scope == "word" and len(term) <= 2 or scope == "line" and len(w) >= 3 and term in w[1:] and term not in (w[0].lower(), w[-1].lower()):
                out.append(x)
    out = set(out) if kind is C else out
    return sorted(((len(x) - len(term)) % 256, x) for x in out)[:100]


def test_random_corpora(spark):
    rng = random.Random(5)
    for _ in range(4):
        texts = ["".join(rng.choice("aabbe .,\n'1A") for _ in range(rng.randrange(80))) for _ in range(30)]
        source = corpus(spark, *texts)
        for scope in ("word", "line"):
            for kind in SearchType:
                for term in ("a", "ab"):
                    assert found(source, scope, kind, term) == model(texts, scope, kind, term), (scope, kind, term)


def test_append_equals_rebuild(spark, tmp_path):
    a, b = "me metal men\nthe met", "met men some\nof the same"
    one, two, three = (str(tmp_path / x) for x in "abc")
    build_all(corpus(spark, a), one)
    append_index(corpus(spark, b), one)
    build_all(corpus(spark, a, b), two)
    compact(spark, one, three)
    for scope in Scope:
        for kind in SearchType:
            for term in ("me", "m"):
                want = found(load_index(spark, two), scope, kind, term)
                assert found(load_index(spark, one), scope, kind, term) == want
                assert found(load_index(spark, three), scope, kind, term) == want


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.txt").write_text("me metal men\r\nsome men")
    query = lambda: start_indexing(stream_texts(spark, str(tmp_path / "in")), str(tmp_path / "ix"), str(tmp_path / "ck")).awaitTermination()
    query()
    (tmp_path / "in/2.txt").write_text("met men\n")
    query()
    index = load_stream_index(spark, str(tmp_path / "ix"))
    whole = read_text(spark, str(tmp_path / "in"))
    for scope in Scope:
        for kind in SearchType:
            assert found(index, scope, kind, "me") == found(whole, scope, kind, "me")


def test_postings(spark, tmp_path):
    build_postings(corpus(spark, "some home time mean"), Scope.WORD, str(tmp_path))
    assert sorted(r.token for r in lookup_postings(spark, str(tmp_path), Scope.WORD, ["me"]).collect()) == ["home", "some", "time"]


def test_pushdown(spark, indexes):
    plan = search(indexes, Scope.WORD, S, "re")._jdf.queryExecution().toString()
    assert "StringStartsWith(token_rev,er)" in plan and "TakeOrderedAndProject" in plan


def test_marks_against_a_model(spark):
    """Graphemes, not characters: a term that ends inside one is not found."""
    import regex

    rng = random.Random(9)
    words = ["".join(rng.choice(["a", "m", "e", "e\u0301", "m\u0302", "\u0303", "x"]) for _ in range(rng.randrange(3, 9))) for _ in range(300)]
    words = [w for w in words if regex.match(r"\p{L}", w)]
    for term in ("e", "me", "m", "ae"):
        want = set()
        for w in words:
            g = regex.findall(r"\X", w)
            grams = [g[i] + g[i + 1] for i in range(1, len(g) - 1)]
            hit = term in grams if len(term) == 2 else any(term in x for x in grams)
            if term in w and not w.startswith(term) and not w.endswith(term) and hit:
                want.add(w)
        got = search(corpus(spark, " ".join(words)), Scope.WORD, C, term, k=1000)
        assert {r.token for r in got.collect()} == want, term


def test_missing_index_has_no_match(spark):
    assert found({}, "word", P, "me") == [] and count_matches({}, Scope.LINE, C, "me").first()[0] == 0


def test_no_split_inside_a_lambda(spark):
    """Words of a line are cut once, not for each position."""
    for name in ("line_contains_phrase", "line_bigrams", "word_bigrams"):
        plan = queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        for inner in plan.split("lambdafunction(")[1:]:
            depth, at = 1, 0
            while depth and at < len(inner):
                depth += (inner[at] == "(") - (inner[at] == ")")
                at += 1
            assert "split(token" not in inner[:at] and "regexp_extract_all(token" not in inner[:at], name


def test_other_scripts_through_search_and_index(spark, tmp_path):
    texts = corpus(spark, "日本語 me", "カタ日me")
    assert found(texts, "word", P, "m", any_script=True) == [(1, "me"), (1, "me")]
    build_all(texts, str(tmp_path), any_script=True)
    assert found(load_index(spark, str(tmp_path)), "word", P, "m") == [(1, "me"), (1, "me")]
    assert found(corpus(spark, "a 日本 b"), "line", C, "日", any_script=True) == [(5, "a 日本 b")]


def test_search_by_postings(spark, tmp_path):
    texts = corpus(spark, "some home time mean\nis it of the one\nof the x")
    for scope, term in ((Scope.WORD, "me"), (Scope.LINE, "of the")):
        build_postings(texts, scope, str(tmp_path))
        assert [tuple(r) for r in search_postings(spark, str(tmp_path), scope, term).collect()] == found(texts, scope, C, term)
    with pytest.raises(ValueError):
        search_postings(spark, str(tmp_path), Scope.WORD, "m")


def test_strict_text(spark, tmp_path):
    (tmp_path / "bad.txt").write_bytes(b"ok \xff line")
    with pytest.raises(Exception, match="UTF-8"):
        read_text(spark, str(tmp_path)).collect()
    assert read_text(spark, str(tmp_path), strict=False).count() == 1


def test_interior_pairs(spark):
    """Pairs of characters where every grapheme is one, of graphemes elsewhere."""
    import regex
    from pyspark.sql import functions as F

    from textquarry.functions.tokenize import interior_pairs

    rng = random.Random(4)
    units = ["a", "é", "é", "日", "👍🏽", "👨‍👩‍👧", "🇩🇪", "각", "कि", "𝒳", "_"]
    tokens_ = ["".join(rng.choice(units[:2] if k % 2 else units) for _ in range(rng.randrange(7))) for k in range(200)]
    got = spark.createDataFrame([(t,) for t in tokens_], "t string").select(interior_pairs(F.col("t"))).collect()
    for t, (pairs,) in zip(tokens_, got, strict=True):
        g = regex.findall(r"\X", t)
        assert pairs == [g[i] + g[i + 1] for i in range(1, len(g) - 1)] if len(g) > 2 else pairs == [], t


def test_separator_class_first(spark):
    """The pattern tests the class before the neighbours: it cuts as it did when it looked at the neighbours of every letter."""
    from pyspark.sql import functions as F
    from textquarry.functions import tokenize as t

    before = rf"(?!(?<=[\p{{L}}\p{{M}}])[{t.MID_LETTER}](?=\p{{L}})|(?<=\p{{Nd}})[{t.MID_NUMBER}](?=\p{{Nd}}))" + r"[^\p{L}\p{M}\p{Nd}\p{Pc}]"
    rng = random.Random(8)
    texts = ["".join(rng.choices("ab1é_٣ .:'’,;·․́\n日\U00010400\U0001f600", k=rng.randrange(14))) for _ in range(4000)]
    rows = corpus(spark, *texts).where(F.split("text", before) != F.split("text", t.WORD_SEPARATOR))
    assert rows.count() == 0 and t.WORD_SEPARATOR.startswith("[^")


def test_postings_are_not_sampled(spark, tmp_path, monkeypatch):
    """A gram of many tokens has several rows, all of whose tokens are found; nothing is cut twice to sample it for ranges."""
    from pyspark.sql import functions as F
    from textquarry.plans import index

    monkeypatch.setattr(index, "POSTINGS_ROW", 3)

    def no_ranges(*_):
        raise AssertionError("ranges are sampled")

    monkeypatch.setattr(type(spark.range(1)), "repartitionByRange", no_ranges)
    words = sorted({"a" + x + "me" + y for x in "bcdfg" for y in "xyz"})
    build_postings(corpus(spark, " ".join(words)), Scope.WORD, str(tmp_path))
    assert sorted(r.token for r in lookup_postings(spark, str(tmp_path), Scope.WORD, ["me"]).collect()) == words
    held = spark.read.parquet(f"{tmp_path}/scope=word/type=postings")
    assert held.where(F.col("gram") == F.array(F.lit("me"))).count() > 1 and held.where(F.col("gram") == F.array(F.lit("bm"))).count() == 1
