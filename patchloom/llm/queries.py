"""The registered queries of the operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from patchloom.llm import anchors, decontaminate, fill_middle, html, jaccard, language_model, manifest, mixing, quality, quotes, sharding, suffixes, token_counts
from patchloom.llm.tables import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


OP3_SQL = r"""
WITH low AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item, least(10, len(w)) AS k, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM windows),
doc_windows AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM low, sizes WHERE len(w) >= k)),
hits AS (SELECT d.doc_id, d.k, d.i, x.item FROM doc_windows d JOIN windows x ON x.k = d.k AND x.win = d.win),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT l.doc_id, CAST(len(l.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated FROM low l LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)"""


@query("op3_decontamination", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("items")


@query("op9_quality_rules")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 90 * (p.n + q.n - k)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON l.a = r.b)
SELECT r.a AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id FROM reach r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a"""


@query("op5_ngram_jaccard", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(read(spark, sf_dir, "documents")).drop("set_id")


@query("op1_mixing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.planned(read(spark, sf_dir, "documents"))


@query("op4_sharding")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(read(spark, sf_dir, "documents"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


@query("op2_suffix_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.without_repeats(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op7_language_model")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.scored(read(spark, sf_dir, "documents"))


@query("op6_html_extraction")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(read(spark, sf_dir, "pages"))


@query("op8_quotation_linking")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.linked(read(spark, sf_dir, "conversations"))


@query("op10_token_counts")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = token_counts.sample_edits(read(spark, sf_dir, "documents"))
    return token_counts.edited(token_counts.trees(docs)).drop("text", "lengths", "tokens")


OP11_SQL = r"""
WITH RECURSIVE shown AS (SELECT *, CASE WHEN crc % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS other FROM (SELECT *, CRC32 AS crc FROM documents)),
leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM
  (SELECT lang, doc_id, sha256(HEAD || FIELD(text)) AS leaf, sha256(HEAD || FIELD(other)) AS shown FROM shown)),
nodes(lang, level, i, n, digest) AS (SELECT lang, 0, i, n, leaf FROM leaves UNION ALL
  SELECT lang, level + 1, i // 8, (any_value(n) + 7) // 8, sha256(string_agg(digest, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY lang, level, i // 8),
subroots AS (SELECT lang, level AS height, digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
upper(level, i, n, digest) AS (SELECT 0, i, n, digest FROM subroots UNION ALL
  SELECT level + 1, i // 8, (any_value(n) + 7) // 8, sha256(string_agg(digest, '' ORDER BY i)) FROM upper WHERE n > 1 GROUP BY level, i // 8),
steps AS (
  SELECT l.lang, l.i AS leaf_i, x.level AS step, coalesce(string_agg(s.digest, '' ORDER BY s.i) FILTER (s.i < x.i), '') AS before, coalesce(string_agg(s.digest, '' ORDER BY s.i) FILTER (s.i > x.i), '') AS after
  FROM leaves l JOIN nodes x ON x.lang IS NOT DISTINCT FROM l.lang AND x.n > 1 AND x.i = l.i // CAST(pow(8, x.level) AS BIGINT)
    JOIN nodes s ON s.lang IS NOT DISTINCT FROM x.lang AND s.level = x.level AND s.i // 8 = x.i // 8 GROUP BY ALL
  UNION ALL
  SELECT l.lang, l.i, r.height + x.level, coalesce(string_agg(s.digest, '' ORDER BY s.i) FILTER (s.i < x.i), ''), coalesce(string_agg(s.digest, '' ORDER BY s.i) FILTER (s.i > x.i), '')
  FROM leaves l JOIN subroots r ON r.lang IS NOT DISTINCT FROM l.lang JOIN upper x ON x.n > 1 AND x.i = r.i // CAST(pow(8, x.level) AS BIGINT)
    JOIN upper s ON s.level = x.level AND s.i // 8 = x.i // 8 GROUP BY l.lang, l.i, r.height, x.level),
proof AS (SELECT lang, leaf_i, sha256(string_agg(before || after, '' ORDER BY step)) AS proof FROM steps GROUP BY ALL),
fold(lang, i, step, digest) AS (SELECT lang, i, 0, shown FROM leaves UNION ALL
  SELECT f.lang, f.i, f.step + 1, sha256(s.before || f.digest || s.after) FROM fold f JOIN steps s ON s.lang IS NOT DISTINCT FROM f.lang AND s.leaf_i = f.i AND s.step = f.step),
top AS (SELECT lang, i, arg_max(digest, step) AS digest FROM fold GROUP BY ALL)
SELECT l.doc_id, l.leaf, r.digest AS subroot, u.digest AS root, coalesce(proof, sha256('')) AS proof_sha256, t.digest AS folded_root, t.digest = u.digest AS verified
FROM leaves l JOIN subroots r ON r.lang IS NOT DISTINCT FROM l.lang JOIN top t ON t.lang IS NOT DISTINCT FROM l.lang AND t.i = l.i
  JOIN (SELECT digest FROM upper WHERE n = 1) u ON true LEFT JOIN proof p ON p.lang IS NOT DISTINCT FROM l.lang AND p.leaf_i = l.i"""

OP11_CRC = "xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT)), lambda a, b: list_reduce([xor(a, b), 1, 1, 1, 1, 1, 1, 1, 1], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"


def op11_sql() -> str:
    """The statement with its crc32 and the fields of a leaf written out."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR) END"
    head = " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars"))
    return OP11_SQL.replace("CRC32", OP11_CRC).replace("HEAD", head).replace("FIELD(text)", field("text")).replace("FIELD(other)", field("other"))


@query("op11_merkle_manifest", op11_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = manifest.proofs(read(spark, sf_dir, "documents"), manifest.lowered_thirds())
    return found.select("doc_id", "leaf", "subroot", "root", manifest.proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", "verified")


OP12_SQL = r"""
WITH w AS (SELECT row_number() OVER () AS r, coalesce(doc_id, 9223372036854775807) AS place, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, place, i, array_to_string(w[i : i + 49], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50)),
firsts AS (SELECT s, min(place) AS least FROM win GROUP BY s),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS p FROM win JOIN firsts USING (s) WHERE least < place),
one AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM w),
kept AS (SELECT o.r, count(*) AS n, string_agg(o.word, ' ' ORDER BY o.p) AS kept FROM one o ANTI JOIN gone g ON g.r = o.r AND g.p = o.p GROUP BY o.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (r)"""


@query("op12_fixed_block_dedup", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = anchors.without_repeats(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
x AS (SELECT *, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM x),
p AS (SELECT *, substring(t, 1, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p"""


@query("op13_fill_in_middle", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.transformed(read(spark, sf_dir, "documents"), keep=["doc_id"])
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(fill_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
