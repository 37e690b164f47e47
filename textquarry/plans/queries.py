"""The registered queries of the text search engine, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.enums import Mode, Scope, SearchType
from textquarry.functions.scoring import highlight, rank_label
from textquarry.functions.tokenize import lines as cut
from textquarry.operators.search import count_matches, count_searches, prepare, search
from textquarry.operators.tokens import bigram_counts, counted, tokens
from textquarry.operators.batch import batch_prefix
from textquarry.plans import documents, sql, store
from textquarry.plans.documents import And, Not, Or, Phrase, Word
from textquarry.plans.fuzzy import build_fuzzy, fuzzy_search
from textquarry.plans.index import append_index, build_all, build_index, build_postings, compact, load_index, load_one, lookup_postings, search_postings
from textquarry.sources import files
from textquarry.sources.corpus import from_column, read_table
from textquarry.sources.shared import new_folder
from textquarry.streaming import windows
from textquarry.streaming.append import load_stream_index, start_indexing

#: name -> (table, column, scope, type, term, mode)
SEARCHES = {
    "word_prefix": ("documents", "text", Scope.WORD, SearchType.PREFIX, "me", Mode.COMPAT),
    "word_suffix": ("documents", "text", Scope.WORD, SearchType.SUFFIX, "en", Mode.COMPAT),
    "word_contains": ("documents", "text", Scope.WORD, SearchType.CONTAINS, "me", Mode.COMPAT),
    "line_prefix": ("part", "p_name", Scope.LINE, SearchType.PREFIX, "cold", Mode.COMPAT),
    "line_suffix": ("part", "p_name", Scope.LINE, SearchType.SUFFIX, "widget", Mode.COMPAT),
    "line_contains": ("documents", "text", Scope.LINE, SearchType.CONTAINS, "the", Mode.COMPAT),
    "line_contains_phrase": ("documents", "text", Scope.LINE, SearchType.CONTAINS, "of the", Mode.COMPAT),
    "word_contains_ext": ("documents", "text", Scope.WORD, SearchType.CONTAINS, "tion", Mode.EXTENDED),
}

_WORDS = (
    r"(?:\p{L}[\p{L}\p{M}]*(?:[:.''\x{B7}\x{2018}\x{2019}\x{2024}\x{2027}]\p{L}[\p{L}\p{M}]*)*"
    r"|\p{Nd}+(?:[,;.''\x{2018}\x{2019}\x{2024}]\p{Nd}+)*|\p{Pc}+)+"
)


def _sql_words(text: str) -> str:
    return rf"list_filter(regexp_extract_all({text}, '{_WORDS}'), lambda x: regexp_matches(x, '[\p{{L}}\p{{N}}]'))"


def _sql_lines(text: str) -> str:
    unix = rf"replace({text}, chr(13) || chr(10), chr(10))"
    cut = f"CASE WHEN right({unix}, 1) = chr(10) THEN left({unix}, length({unix}) - 1) ELSE {unix} END"
    return f"CASE WHEN {text} = '' THEN [] ELSE string_split({cut}, chr(10)) END"


def _sql_items(table: str, column: str, scope: Scope) -> str:
    cut = _sql_words(column) if scope is Scope.WORD else _sql_lines(column)
    return (
        f"SELECT token FROM (SELECT unnest({cut}) AS token FROM {table} WHERE {column} IS NOT NULL) "
        f"WHERE strlen(token) <= {scope.max_bytes}"
    )


def _sql_matches(table: str, column: str, scope: Scope, kind: SearchType, term: str, mode: Mode) -> str:
    inside = f"contains(token, '{term}') AND NOT starts_with(token, '{term}') AND NOT ends_with(token, '{term}')"
    test = {
        SearchType.PREFIX: f"starts_with(token, '{term}') AND token <> '{term}'",
        SearchType.SUFFIX: f"ends_with(token, '{term}') AND token <> '{term}'",
        SearchType.CONTAINS: inside,
    }[kind]
    items = _sql_items(table, column, scope)
    if scope is Scope.LINE:
        items = f"SELECT token, {_sql_words('token')} AS w FROM ({items}) WHERE {test}"
        parts = term.split()
        gram = (
            f"len(w) >= 3 AND list_contains(w[2:], '{term}')"
            if len(parts) < 2
            else f"len(list_filter(range(2, len(w)), lambda i: w[i] || ' ' || w[i + 1] = '{term}')) > 0"
        )
        test = {
            SearchType.PREFIX: f"lower(w[1]) = '{term}'",
            SearchType.SUFFIX: f"lower(w[-1]) = '{term}'",
            SearchType.CONTAINS: f"len(w) > 0 AND lower(w[1]) <> '{term}' AND lower(w[-1]) <> '{term}' AND {gram}",
        }[kind]
    distinct = "DISTINCT " if kind is SearchType.CONTAINS else ""
    return f"SELECT {distinct}token FROM ({items}) WHERE {test}"


def _sql_search(spec: tuple) -> str:
    term = spec[4]
    return (
        f"SELECT CAST((length(token) - {len(term)}) % 256 AS INTEGER) AS priority, token "
        f"FROM ({_sql_matches(*spec)}) ORDER BY priority, token LIMIT 100"
    )


def _run(spec: tuple):
    table, column, scope, kind, term, mode = spec
    return lambda spark, sf: search(read_table(spark, sf, table, column), scope, kind, term, mode)


def _token_counts(scope: Scope):
    return lambda spark, sf: counted(tokens(read_table(spark, sf, "documents", "text"), scope)).withColumnRenamed("freq", "n")


def _gram_counts(table: str, scope: Scope):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        items = tokens(read_table(spark, sf, table, "text"), scope).distinct()
        return bigram_counts(items, scope).select(F.array_join("gram", " ").alias("gram"), "n_items")

    return run


COUNTED = [(scope, kind, term) for scope in Scope for kind, term in ((SearchType.PREFIX, "th"), (SearchType.SUFFIX, "en"), (SearchType.CONTAINS, "me"))]


def _result_counts(spark: SparkSession, sf: str) -> DataFrame:
    return count_searches(read_table(spark, sf, "documents", "text"), COUNTED).drop("term")


def _sql_result_counts(table: str = "documents", lost: tuple = ()) -> str:
    return " UNION ALL ".join(
        f"SELECT '{scope.value}' AS scope, '{kind.value}' AS type, count(*) AS n_matches "
        f"FROM ({_sql_matches(table, 'text', scope, kind, term, Mode.COMPAT)}) WHERE {(scope, kind) not in lost}"
        for scope, kind, term in COUNTED
    )


def _rank_label(spark: SparkSession, sf: str) -> DataFrame:
    return _run(SEARCHES["word_contains"])(spark, sf).select(rank_label().alias("label"), "priority", "token")


def _highlight(spark: SparkSession, sf: str) -> DataFrame:
    h = highlight(F.col("token"), "me")
    found = _run(SEARCHES["word_contains"])(spark, sf).select("token", h.alias("h"))
    return found.select("token", F.col("h.pre").alias("pre"), F.col("h.hit").alias("hit"), F.col("h.post").alias("post"))


def _size_guard(spark: SparkSession, sf: str) -> DataFrame:
    lines = read_table(spark, sf, "documents", "text")
    every = lines.select(F.explode_outer(cut(F.col("text"))).alias("token")).where(F.col("token").isNotNull())
    over = (F.octet_length("token") > Scope.LINE.max_bytes).cast("long")
    return every.agg(F.count(F.lit(1)).alias("n_lines"), F.coalesce(F.sum(over), F.lit(0)).cast("long").alias("n_dropped"))


def _line_words(spark: SparkSession, sf: str) -> DataFrame:
    return prepare(read_table(spark, sf, "part", "p_name"), Scope.LINE).select(
        "token", F.size("words").alias("n_words"), "first_lc", "last_lc"
    )


#: Searches over persisted indexes.
INDEXED = {f"indexed_{name}": SEARCHES[name] for name in ("word_prefix", "word_suffix", "word_contains", "line_prefix", "line_suffix", "line_contains")}
_BUILT: dict[tuple, str] = {}


def _built(spark: SparkSession, sf: str, what: str, build) -> str:
    """The folder of an index, built when first asked for in a session."""
    key = (spark.sparkContext.applicationId, sf, what)
    if key not in _BUILT:
        root = new_folder(spark, what)
        build(root)
        _BUILT[key] = root
    return _BUILT[key]


def _indexed(spec: tuple):
    table, column, scope, kind, term, mode = spec

    def run(spark: SparkSession, sf: str) -> DataFrame:
        root = _built(spark, sf, f"index-{table}", lambda r: build_all(read_table(spark, sf, table, column), r))
        return search(load_index(spark, root), scope, kind, term, mode)

    return run


def _index_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and multiplicities of the six indexes, and whether each suffix row holds its token reversed."""
    root = _built(spark, sf, "index-documents", lambda r: build_all(read_table(spark, sf, "documents", "text"), r))
    rows = None
    for (scope, kind), index in load_index(spark, root).items():
        straight = (F.reverse("token_rev") == F.col("token")) if kind is SearchType.SUFFIX else F.lit(True)
        n = index.agg(F.count(F.lit(1)).alias("n_tokens"), F.coalesce(F.sum("freq"), F.lit(0)).alias("n_items"), F.coalesce(F.bool_and(straight), F.lit(True)).alias("straight"))
        n = n.select(F.lit(scope.value).alias("scope"), F.lit(kind.value).alias("type"), "n_tokens", "n_items", "straight")
        rows = n if rows is None else rows.unionByName(n)
    return rows


def _postings(scope: Scope, table: str):
    def root(spark: SparkSession, sf: str) -> str:
        return _built(spark, sf, f"postings-{scope.value}", lambda r: build_postings(read_table(spark, sf, table, "text"), scope, r))

    return root


def _postings_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return lookup_postings(spark, _postings(Scope.WORD, "documents")(spark, sf), Scope.WORD, ["me"])


def _postings_words(spark: SparkSession, sf: str) -> DataFrame:
    return search_postings(spark, _postings(Scope.WORD, "documents")(spark, sf), Scope.WORD, "me")


def _postings_lines(spark: SparkSession, sf: str) -> DataFrame:
    return search_postings(spark, _postings(Scope.LINE, "conversations")(spark, sf), Scope.LINE, "of the")


def _stray(spark: SparkSession, sf: str) -> DataFrame:
    """Postings whose lines that begin with a T are gone: their ids are ignored."""

    def build(root: str) -> None:
        build_postings(read_table(spark, sf, "conversations", "text"), Scope.LINE, f"{root}/all")
        spark.read.parquet(f"{root}/all/scope=line/type=postings").write.parquet(f"{root}/scope=line/type=postings")
        left = spark.read.parquet(f"{root}/all/scope=line/type=items").where(~F.col("token").startswith("T"))
        left.write.mode("overwrite").parquet(f"{root}/scope=line/type=items")

    return search_postings(spark, _built(spark, sf, "stray", build), Scope.LINE, "of the")


def _lost(spark: SparkSession, sf: str) -> DataFrame:
    """Matches of each index, one of which is gone from the disk and has none."""

    def build(root: str) -> None:
        build_all(read_table(spark, sf, "conversations", "text"), root)
        name = store.version(spark, root).segments[0].name
        files.remove(spark, store.dataset(root, name, Scope.WORD, SearchType.SUFFIX.index_name))

    index, rows = load_index(spark, _built(spark, sf, "lost", build), strict=False), None
    for scope, kind, term in COUNTED:
        n = count_matches(index, scope, kind, term).select(F.lit(scope.value).alias("scope"), F.lit(kind.value).alias("type"), "n_matches")
        rows = n if rows is None else rows.unionByName(n)
    return rows


def _appended(spark: SparkSession, sf: str, merged: bool) -> DataFrame:
    def build(root: str) -> None:
        build_all(read_table(spark, sf, "conversations", "text"), root)
        append_index(read_table(spark, sf, "benchmark", "text"), root)

    root = _built(spark, sf, "appended", build)
    if merged:
        root = _built(spark, sf, "compacted", lambda r: compact(spark, root, r))
    return search(load_index(spark, root), Scope.WORD, SearchType.PREFIX, "me")


def _streamed(spark: SparkSession, sf: str) -> DataFrame:
    def build(root: str) -> None:
        name = "conversations.parquet"
        table = spark.read.parquet(f"{sf}/{name}")
        stream = spark.readStream.schema(table.schema)
        # A file stream reads folders; the table may be one file.
        single = table.inputFiles()[0].endswith(f"/{name}")
        texts = stream.option("pathGlobFilter", name).parquet(sf) if single else stream.parquet(f"{sf}/{name}")
        start_indexing(from_column(texts, "text"), root, f"{root}-checkpoint").awaitTermination()

    return search(load_stream_index(spark, _built(spark, sf, "streamed", build)), Scope.WORD, SearchType.SUFFIX, "en")


def _identified(spark: SparkSession, sf: str, table: str, column: str, key: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/{table}.parquet")
    return rows.select(F.col(key).alias("doc_id"), F.col(column).alias("text")).where(F.col("text").isNotNull())


def _changed(spark: SparkSession, sf: str) -> str:
    """An index of documents: built, items appended twice under one batch number, and every seventh document and item deleted."""

    def build(root: str) -> None:
        store.build(_identified(spark, sf, "documents", "text", "doc_id"), root)
        more = spark.read.parquet(f"{sf}/pages.parquet").select((-F.col("page_id") - 1).alias("doc_id"), F.col("url").alias("text"))
        for _ in range(2):
            store.append(more, root, source="pages", batch=0)
        store.delete(spark.read.parquet(f"{sf}/documents.parquet").where("doc_id % 7 = 0").select("doc_id"), root)
        store.delete(more.where("doc_id % 7 = 0").select("doc_id"), root)

    return _built(spark, sf, "changed", build)


def _snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """The first version, read after the index has changed."""
    return search(load_index(spark, _changed(spark, sf), version=0), Scope.WORD, SearchType.PREFIX, "th")


def _deleted(scope: Scope, kind: SearchType, term: str, merged: bool):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        root = _changed(spark, sf)
        if merged:
            root = _built(spark, sf, "changed-merged", lambda to, root=root: compact(spark, root, to))
        return search(load_index(spark, root), scope, kind, term)

    return run


#: Rows that the deletes of ``_changed`` leave.
_SQL_LEFT = "(SELECT text FROM documents WHERE doc_id % 7 <> 0 UNION ALL SELECT url AS text FROM pages WHERE (page_id + 1) % 7 <> 0) AS x"


def _single(spark: SparkSession, sf: str) -> DataFrame:
    """One index of one scope, and a search of it."""
    scope, kind = Scope.LINE, SearchType.SUFFIX
    root = _built(spark, sf, "single", lambda r: build_index(read_table(spark, sf, "part", "p_name"), scope, kind, r))
    return search(load_one(spark, root, scope, kind), scope, kind, "widget")


LAYOUT = documents.Documents(("text", "source"), ("lang", "source"))
PHRASES = {"phrase_search_2": ("and", "the"), "phrase_search_3": ("thanedble", "the", "anea"), "phrase_search_5": ("to", "thanedble", "the", "anea", "eriner")}
#: Both halves of an Or, a phrase, and what is left out.
EXPRESSION = And(Or(Word("thanedble"), And(Word("and"), Word("the"))), Not(Phrase(("of", "and"))), Not(Word("src1", "source")))
BM25_WORDS = ["thanedble", "anea", "is", "src2"]
BM25_FIELDS = {"text": 1.0, "source": 0.5}


def _documents(spark: SparkSession, sf: str) -> documents.Index:
    """Postings of documents: half of them built, half appended, every eleventh deleted."""

    def build(root: str) -> None:
        rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source")
        store.build(rows.where("doc_id % 2 = 0"), root, LAYOUT)
        store.append(rows.where("doc_id % 2 <> 0"), root, LAYOUT)
        store.delete(rows.where("doc_id % 11 = 0"), root, LAYOUT)

    return documents.Index(spark, _built(spark, sf, "documents", build))


def _phrase(words: tuple[str, ...]):
    return lambda spark, sf: documents.phrase_search(_documents(spark, sf), list(words))


def _fuzzy(distance: int):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        items = lambda: counted(tokens(read_table(spark, sf, "documents", "text"), Scope.WORD))
        root = _built(spark, sf, "fuzzy", lambda r: build_fuzzy(items(), r, 2))
        # The SQL's distance counts bytes, so both sides leave other words out.
        return fuzzy_search(spark, root, "thanedble", distance).where(F.octet_length("token") == F.char_length("token"))

    return run


def _batch(spark: SparkSession, sf: str) -> DataFrame:
    """Terms are the words of two to five letters a-z of the benchmark."""
    terms = tokens(read_table(spark, sf, "benchmark", "text"), Scope.WORD).where(F.col("token").rlike("^[a-z]{2,5}$")).select(F.col("token").alias("term"))
    return batch_prefix(counted(tokens(read_table(spark, sf, "documents", "text"), Scope.WORD)), terms, 20)


def _windowed(spark: SparkSession, sf: str) -> DataFrame:
    name = "events.parquet"
    table = spark.read.parquet(f"{sf}/{name}")
    single = table.inputFiles()[0].endswith(f"/{name}")
    stream = spark.readStream.schema(table.schema)
    raw = stream.option("pathGlobFilter", name).parquet(sf) if single else stream.parquet(f"{sf}/{name}")
    events = raw.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "user_id", F.col("value").cast("decimal(18,4)").alias("value"))
    kinds = {
        "tumbling": windows.tumbling(events, "event_type", "value", "6 hours", "10 minutes"),
        "sliding": windows.sliding(events, "event_type", "value", "12 hours", "6 hours", "10 minutes"),
        "session": windows.sessions(events, "user_id", "value", "90 minutes", "10 minutes"),
    }

    def build(root: str) -> None:
        started = [windows.start(counts, f"{root}/{kind}", f"{root}/checkpoint-{kind}") for kind, counts in kinds.items()]
        for query in started:
            query.awaitTermination()

    root, rows = _built(spark, sf, "windows", build), None
    for kind, counts in kinds.items():
        some = windows.closed(spark, counts, f"{root}/{kind}")
        some = some.select(F.lit(kind).alias("kind"), "key", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n", F.col("total").cast("double").alias("total"))
        rows = some if rows is None else rows.unionByName(some)
    return rows


def _sql_search_function(spark: SparkSession, sf: str) -> DataFrame:
    root = _built(spark, sf, "index-documents", lambda r: build_all(read_table(spark, sf, "documents", "text"), r))
    sql.register(spark, load_index(spark, root))
    text = (
        "SELECT priority, token FROM text_search('word', 'prefix', :term) LATERAL VIEW explode(sequence(1, CAST(least(freq, 100) AS INT))) AS copy "
        "ORDER BY priority, token LIMIT 100"
    )
    return spark.sql(text, args={"term": "th"})


#: Documents of ``_documents`` with their words.
_SQL_WORDS = f"(SELECT doc_id, lang, source, {_sql_words('lower(text)')} AS w, {_sql_words('lower(source)')} AS s FROM documents WHERE doc_id % 11 <> 0)"


def _sql_starts(words: tuple[str, ...]) -> str:
    tests = " AND ".join(f"w[i + {j}] = '{w}'" for j, w in enumerate(words))
    return f"list_filter(range(1, coalesce(len(w), 0) - {len(words) - 2}), lambda i: {tests})"


_SQL_MATCHES = (
    f"(SELECT doc_id, lang, source FROM {_SQL_WORDS} WHERE (list_contains(w, 'thanedble') OR (list_contains(w, 'and') AND list_contains(w, 'the'))) "
    f"AND len({_sql_starts(('of', 'and'))}) = 0 AND NOT list_contains(s, 'src1'))"
)


def _sql_bm25() -> str:
    parts = []
    for field, weight in BM25_FIELDS.items():
        c = {"text": "w", "source": "s"}[field]
        for word in BM25_WORDS:
            n = f"len(list_filter({c}, lambda x: x = '{word}'))"
            df = f"(SELECT count(*) FROM d WHERE list_contains({c}, '{word}'))"
            gain = f"{n} * 2.2 / ({n} + 1.2 * (0.25 + 0.75 * len({c}) / (SELECT sum(len({c})) / count(*) FROM d)))"
            parts.append(f"SELECT doc_id, {weight} * ln(1 + ((SELECT count(*) FROM d) - {df} + 0.5) / ({df} + 0.5)) * {gain} AS score FROM d WHERE list_contains({c}, '{word}')")
    return (
        f"WITH d AS (SELECT doc_id, coalesce(w, []) AS w, coalesce(s, []) AS s FROM {_SQL_WORDS}) "
        f"SELECT doc_id, round(sum(score), 6) AS score FROM ({' UNION ALL '.join(parts)}) GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 100"
    )


def _sql_windows() -> str:
    """Windows whose end the watermark, the last time less ten minutes, has passed."""
    us, hour = "epoch_us(ts)", 3_600_000_000
    rows = f"(SELECT {us} AS t, event_type, CAST(user_id AS VARCHAR) AS user_id, CAST(value AS DECIMAL(18,4)) AS value FROM events) AS e"
    sums = "count(*) AS n, sum(value) AS total"
    fixed = [
        f"SELECT '{kind}' AS kind, event_type AS key, t - t % {6 * hour} - {back} AS start_us, t - t % {6 * hour} - {back} + {size * hour} AS end_us, {sums} FROM {rows} GROUP BY event_type, t - t % {6 * hour}"
        for kind, size, backs in (("tumbling", 6, (0,)), ("sliding", 12, (0, 6 * hour)))
        for back in backs
    ]
    sliding = f"SELECT kind, key, start_us, end_us, CAST(sum(n) AS BIGINT) AS n, sum(total) AS total FROM ({' UNION ALL '.join(fixed)}) GROUP BY kind, key, start_us, end_us"
    gap = 90 * 60 * 1_000_000
    opened = f"SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) < {gap} THEN 0 ELSE 1 END AS opens FROM {rows}"
    numbered = f"SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS session FROM ({opened})"
    session = f"SELECT 'session' AS kind, user_id AS key, min(t) AS start_us, max(t) + {gap} AS end_us, {sums} FROM ({numbered}) GROUP BY user_id, session"
    return f"SELECT kind, key, start_us, end_us, n, CAST(total AS DOUBLE) AS total FROM ({sliding} UNION ALL {session}) WHERE end_us <= (SELECT max({us}) FROM events) - 600000000"


def queries() -> dict:
    return {name: _run(spec) for name, spec in SEARCHES.items()} | {name: _indexed(spec) for name, spec in INDEXED.items()} | {
        "index_counts": _index_counts,
        "postings_lookup": _postings_lookup,
        "postings_word_contains": _postings_words,
        "postings_line_contains": _postings_lines,
        "stray_postings": _stray,
        "lost_index_counts": _lost,
        "appended_search": lambda spark, sf: _appended(spark, sf, False),
        "compacted_search": lambda spark, sf: _appended(spark, sf, True),
        "streamed_search": _streamed,
        "snapshot_search": _snapshot,
        "deleted_search": _deleted(Scope.WORD, SearchType.PREFIX, "th", False),
        "deleted_line_search": _deleted(Scope.LINE, SearchType.CONTAINS, "the", False),
        "deleted_compacted_search": _deleted(Scope.WORD, SearchType.PREFIX, "th", True),
        "single_index_search": _single,
        **{name: _phrase(words) for name, words in PHRASES.items()},
        "fuzzy_word_1": _fuzzy(1),
        "fuzzy_word_2": _fuzzy(2),
        "boolean_search": lambda spark, sf: documents.boolean_search(_documents(spark, sf), EXPRESSION),
        "bm25_search": lambda spark, sf: documents.bm25_search(_documents(spark, sf), BM25_WORDS, BM25_FIELDS),
        "facet_counts": lambda spark, sf: documents.facets(_documents(spark, sf), EXPRESSION, ["lang", "source"]),
        "facet_cube": lambda spark, sf: documents.facets(_documents(spark, sf), Word("the"), ["lang", "source"], cube=True),
        "batch_prefix": _batch,
        "windowed_counts": _windowed,
        "sql_search": _sql_search_function,
        "result_tokens": lambda spark, sf: _run(SEARCHES["word_prefix"])(spark, sf).select("token"),
        "word_tokens": _token_counts(Scope.WORD),
        "line_tokens": _token_counts(Scope.LINE),
        "word_bigrams": _gram_counts("documents", Scope.WORD),
        "line_bigrams": _gram_counts("conversations", Scope.LINE),
        "result_counts": _result_counts,
        "rank_label": _rank_label,
        "highlight": _highlight,
        "size_guard": _size_guard,
        "line_words": _line_words,
    }


def oracle_sql() -> dict[str, str]:
    word_items, line_items = _sql_items("documents", "text", Scope.WORD), _sql_items("documents", "text", Scope.LINE)
    contains = _sql_search(SEARCHES["word_contains"])
    talk = f"SELECT DISTINCT token FROM ({_sql_items('conversations', 'text', Scope.LINE)})"
    both = "(SELECT text FROM conversations UNION ALL SELECT text FROM benchmark) AS x"
    more = ("word", "line")
    counts = {s: f"(SELECT count(DISTINCT token) AS n_tokens, count(*) AS n_items FROM ({i}))" for s, i in zip(more, (word_items, line_items), strict=True)}
    return {name: _sql_search(spec) for name, spec in (SEARCHES | INDEXED).items()} | {
        "index_counts": " UNION ALL ".join(
            f"SELECT '{s}' AS scope, '{k.value}' AS type, n_tokens, n_items, true AS straight FROM {counts[s]}" for s in more for k in SearchType
        ),
        "postings_lookup": (
            f"SELECT DISTINCT token FROM ({word_items}) WHERE len(list_filter(range(2, length(token)), lambda i: substr(token, i, 2) = 'me')) > 0"
        ),
        "postings_word_contains": contains,
        "postings_line_contains": _sql_search(("conversations", "text", Scope.LINE, SearchType.CONTAINS, "of the", Mode.COMPAT)),
        "stray_postings": _sql_search(("(SELECT token AS text FROM (" + talk + ") WHERE NOT starts_with(token, 'T')) AS x", "text", Scope.LINE, SearchType.CONTAINS, "of the", Mode.COMPAT)),
        "lost_index_counts": _sql_result_counts("conversations", ((Scope.WORD, SearchType.SUFFIX),)),
        "appended_search": _sql_search((both, "text", Scope.WORD, SearchType.PREFIX, "me", Mode.COMPAT)),
        "compacted_search": _sql_search((both, "text", Scope.WORD, SearchType.PREFIX, "me", Mode.COMPAT)),
        "streamed_search": _sql_search(("conversations", "text", Scope.WORD, SearchType.SUFFIX, "en", Mode.COMPAT)),
        "snapshot_search": _sql_search(("documents", "text", Scope.WORD, SearchType.PREFIX, "th", Mode.COMPAT)),
        "deleted_search": _sql_search((_SQL_LEFT, "text", Scope.WORD, SearchType.PREFIX, "th", Mode.COMPAT)),
        "deleted_line_search": _sql_search((_SQL_LEFT, "text", Scope.LINE, SearchType.CONTAINS, "the", Mode.COMPAT)),
        "deleted_compacted_search": _sql_search((_SQL_LEFT, "text", Scope.WORD, SearchType.PREFIX, "th", Mode.COMPAT)),
        "single_index_search": _sql_search(SEARCHES["line_suffix"]),
        **{
            name: f"SELECT doc_id, CAST(len(starts) AS BIGINT) AS n_hits, starts[1] - 1 AS first FROM (SELECT doc_id, {_sql_starts(words)} AS starts FROM {_SQL_WORDS}) WHERE len(starts) > 0"
            for name, words in PHRASES.items()
        },
        **{
            f"fuzzy_word_{d}": f"SELECT CAST(levenshtein(token, 'thanedble') AS INTEGER) AS distance, token, count(*) AS freq FROM ({word_items}) WHERE strlen(token) = length(token) AND levenshtein(token, 'thanedble') <= {d} GROUP BY token"
            for d in (1, 2)
        },
        "boolean_search": f"SELECT doc_id FROM {_SQL_MATCHES}",
        "bm25_search": _sql_bm25(),
        "facet_counts": f"SELECT lang, source, grouping(lang, source) AS grouping, count(*) AS n_docs FROM {_SQL_MATCHES} GROUP BY ROLLUP (lang, source)",
        "facet_cube": f"SELECT lang, source, grouping(lang, source) AS grouping, count(*) AS n_docs FROM {_SQL_WORDS} WHERE list_contains(w, 'the') GROUP BY CUBE (lang, source)",
        "batch_prefix": (
            f"WITH i AS (SELECT token, count(*) AS freq FROM ({word_items}) GROUP BY token), "
            f"t AS (SELECT DISTINCT token AS term, length(token) AS size FROM ({_sql_items('benchmark', 'text', Scope.WORD)}) WHERE regexp_full_match(token, '[a-z]{{2,5}}')), "
            "laid AS (SELECT left(token, size) AS term, token, freq FROM i, (SELECT DISTINCT size FROM t) WHERE length(token) > size), "
            "copies AS (SELECT term, CAST((length(token) - length(term)) % 256 AS INTEGER) AS priority, token, unnest(range(0, least(freq, 20))) AS c FROM laid JOIN t USING (term)), "
            "ranked AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY priority, token) AS place FROM copies) "
            "SELECT term, priority, token FROM ranked WHERE place <= 20"
        ),
        "windowed_counts": _sql_windows(),
        "sql_search": _sql_search(("documents", "text", Scope.WORD, SearchType.PREFIX, "th", Mode.COMPAT)),
        "result_tokens": f"SELECT token FROM ({_sql_search(SEARCHES['word_prefix'])})",
        "word_tokens": f"SELECT token, count(*) AS n FROM ({word_items}) GROUP BY token",
        "line_tokens": f"SELECT token, count(*) AS n FROM ({line_items}) GROUP BY token",
        "word_bigrams": (
            "SELECT gram, count(*) AS n_items FROM (SELECT DISTINCT token, unnest(list_transform(range(2, length(token)), "
            f"lambda i: substr(token, i, 2))) AS gram FROM (SELECT DISTINCT token FROM ({word_items}))) GROUP BY gram"
        ),
        "line_bigrams": (
            "SELECT gram, count(*) AS n_items FROM (SELECT DISTINCT token, unnest(list_transform(range(2, len(w)), "
            f"lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM (SELECT token, {_sql_words('token')} AS w FROM ({talk}))) GROUP BY gram"
        ),
        "result_counts": _sql_result_counts(),
        "rank_label": (
            "SELECT '#' || row_number() OVER (ORDER BY priority, token) || ' -> ' AS label, priority, token "
            f"FROM ({contains})"
        ),
        "highlight": (
            "SELECT token, left(token, p - 1) AS pre, substr(token, p, 2) AS hit, substr(token, p + 2) AS post "
            f"FROM (SELECT token, strpos(lower(token), 'me') AS p FROM ({contains}))"
        ),
        "size_guard": (
            "SELECT count(*) AS n_lines, count(*) FILTER (strlen(token) > 32768) AS n_dropped FROM "
            f"(SELECT unnest({_sql_lines('text')}) AS token FROM documents WHERE text IS NOT NULL)"
        ),
        "line_words": (
            "SELECT token, CAST(len(w) AS INTEGER) AS n_words, lower(w[1]) AS first_lc, lower(w[-1]) AS last_lc "
            f"FROM (SELECT token, {_sql_words('token')} AS w FROM ({_sql_items('part', 'p_name', Scope.LINE)}))"
        ),
    }
