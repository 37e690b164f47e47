"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm import (
    collocations,
    decontamination,
    jaccard_join,
    packing,
    prefix_trie,
    quality_classifier,
    quality_rules,
    sharding,
    storage,
    substring_dedup,
    token_counts,
    token_files,
    toxicity,
    warc,
)

BYTE_BPE = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = storage.new_folder(spark, "token-files")
    files = token_files.write(_table(spark, sf_dir, "documents"), folder, public_tokenizers.path(BYTE_BPE), end_id=2)
    return token_files.digest(spark, files)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = storage.new_folder(spark, "packing")
    files = packing.encode(_table(spark, sf_dir, "documents"), folder, public_tokenizers.path(BYTE_BPE), end_id=1)
    return packing.pieces(spark, files)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(_table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES), limit=4096)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.assign(_table(spark, sf_dir, "documents"), 16)
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(_table(spark, sf_dir, "documents"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = storage.new_folder(spark, "warc")
    warc.write(_table(spark, sf_dir, "pages"), folder)
    return warc.read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(_table(spark, sf_dir, "conversations"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


#: SQL for op10: overlaps of all pairs that share a shingle, and a recursive walk over the links.
_OP10_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS MATERIALIZED (SELECT a, b FROM pairs_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
walk AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT walk.a, link.b FROM walk JOIN link ON walk.b = link.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id FROM w LEFT JOIN n USING (doc_id)
JOIN (SELECT a AS doc_id, min(b) AS component_id FROM walk GROUP BY a) r USING (doc_id)
"""

#: SQL for op4: the same windows by joins of exploded words.
_OP4_SQL = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda i: array_to_string(w[i:i + least(10, len(w)) - 1], ' '))) AS win FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS p, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS win FROM d, sizes WHERE len(w) >= k),
h AS (SELECT doc_id, p, dw.k AS k, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.k = bw.k),
covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM (SELECT DISTINCT doc_id, p, k FROM h)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

#: SQL for op11.
_OP11_SQL = """
SELECT page_id, strlen(p) AS payload_bytes, sha1(p) AS payload_digest, CASE WHEN page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM (SELECT page_id, p, CASE WHEN strlen(p) >= 1000 THEN max(page_id) OVER (PARTITION BY p) ELSE page_id END AS keeper FROM (SELECT page_id, coalesce(html, '') AS p FROM pages))
"""

#: SQL for op12: nodes are lists of turns, and each adds to the totals of all lists that it starts with.
_OP12_SQL = """
WITH o AS (SELECT conv_id, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT conv_id, list(x ORDER BY pos) AS w, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)) AS digits FROM o GROUP BY conv_id),
h AS (SELECT conv_id, w, xor(list_reduce(list_prepend(4294967295, digits), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda u, k: xor(u >> 1, 3988292384 * (u & 1)))), 4294967295) % 9 AS h FROM t),
r AS (SELECT h.conv_id, list_concat(coalesce(f.w, [])[1:h], h.w[h + 1:]) AS w FROM h LEFT JOIN t f ON f.conv_id = h.conv_id - h.conv_id % 5),
m AS (SELECT conv_id, d, w[1:d] AS p, len(w) = d AS ends FROM (SELECT conv_id, w, unnest(range(0, len(w) + 1)) AS d FROM r)),
n AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '') AS ids, CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * strlen(p[d].t) END AS own FROM m GROUP BY p, d),
up AS (SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
k AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN up ON up.p = n.p AND up.d = n.d),
total AS (SELECT p[1:e] AS p, e AS d, CAST(count(*) FILTER (n_children = 0) AS BIGINT) AS n_leaves, CAST(sum(own) AS BIGINT) AS saved_tokens FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM k) GROUP BY ALL)
SELECT k.conv_id, k.d AS depth, parent.conv_id AS parent_conv_id, k.n_convs, k.n_children, n_leaves, saved_tokens, sha256(k.ids) AS ends_sha256
FROM k JOIN total ON total.p = k.p AND total.d = k.d LEFT JOIN n parent ON parent.d = k.d - 1 AND parent.p = k.p[1:k.d - 1]
"""

#: SQL for op13: every phrase counted, every cut scored, and every longer candidate looked at, not only those of one word more.
_OP13_SQL = """
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM p),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k),
c AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 30),
cuts AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS j FROM c WHERE k > 1),
s AS (SELECT cuts.lang, cuts.phrase, cuts.a, j, x.a AS l, y.a AS r, CAST(CAST(2000000 AS HUGEINT) * cuts.a // (x.a + y.a) AS BIGINT) AS score
      FROM cuts JOIN c x ON x.lang = cuts.lang AND x.phrase = array_to_string(w[1:j], ' ') JOIN c y ON y.lang = cuts.lang AND y.phrase = array_to_string(w[j + 1:], ' ')),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
within AS (SELECT lang, a, unnest(flatten(list_transform(range(2, k), lambda m: list_transform(range(1, k - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))))) AS phrase FROM (SELECT DISTINCT lang, k, phrase, a, w FROM cuts)),
kept AS (SELECT * FROM best WHERE NOT EXISTS (SELECT 1 FROM within WHERE within.lang = best.lang AND within.phrase = best.phrase AND 100 * CAST(within.a AS HUGEINT) >= 80 * CAST(best.a AS HUGEINT)))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
"""


def queries() -> dict:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_token_files": op2_token_files,
        "op3_quality_rules": op3_quality_rules,
        "op4_decontamination": op4_decontamination,
        "op5_packing": op5_packing,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_token_counts": op7_token_counts,
        "op8_sharding": op8_sharding,
        "op9_quality_classifier": op9_quality_classifier,
        "op10_jaccard_join": op10_jaccard_join,
        "op11_warc": op11_warc,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_collocations": op13_collocations,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_decontamination": _OP4_SQL, "op10_jaccard_join": _OP10_SQL, "op11_warc": _OP11_SQL, "op12_prefix_trie": _OP12_SQL, "op13_collocations": _OP13_SQL}
