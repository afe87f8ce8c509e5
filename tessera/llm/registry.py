"""Queries of the subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, brown_lm, crf_langid, divergence_rules, hyperminhash, hyperplane_dedup, mixing, nbsvm, style_tree, warc_zstd
from tessera.llm.shared import bit_of_id, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@_query
def op1_nbsvm(spark: SparkSession, sf: str) -> DataFrame:
    docs, held = table(spark, sf, "documents"), bit_of_id("doc_id", 4) == 2
    model = nbsvm.fit(docs, table(spark, sf, "labels"), ~held)
    return nbsvm.score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= nbsvm.ACCEPT).cast("int").alias("predicted"))


@_query
def op2_warc(spark: SparkSession, sf: str) -> DataFrame:
    return warc_zstd.round_trip(table(spark, sf, "pages")).drop("url")


ORACLES["op2_warc"] = r"""
WITH given AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
digits AS (SELECT *, list_transform(range(0, 8), lambda k: CAST('0x' || substr(h, CAST(5 * k + 1 AS BIGINT), 5) AS BIGINT)) AS five FROM given),
first AS (SELECT h, min(page_id) AS m FROM given GROUP BY h)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(five, lambda v: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v >> 15) & 31), 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v >> 10) & 31), 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v >> 5) & 31), 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (v & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> m THEN m END AS refers_to
FROM digits JOIN first USING (h)"""


@_query
def op3_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.schedule(table(spark, sf, "documents"))


@_query
def op5_style_tree(spark: SparkSession, sf: str) -> DataFrame:
    return style_tree.extract(table(spark, sf, "pages"))


@_query
def op6_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.digests(table(spark, sf, "documents"))


@_query
def op7_divergence(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return divergence_rules.rules(docs, divergence_rules.reference(docs)).drop("class_distance", "word_distance")


#: Words of lower-cased texts, and of texts as they are.
_LOWERED = r"""translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"""
_SPLIT = r"""list_filter(regexp_split_to_array({0}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"""
_CLASSES = "[a-z]", "[A-Z]", "[0-9]", r"[\x09-\x0D\x20]", r"""[.,;:!?''"\-]""", r"[()\[\]{}]", "[#*$%&|<>]", r"[\x00-\x08\x0E-\x1F\x7F/=@\\^_`~+]", r"[^\x00-\x7F]"

ORACLES["op7_divergence"] = rf"""
WITH given AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t, {_SPLIT.format("coalesce(text, '')")} AS w, {_SPLIT.format(_LOWERED)} AS v FROM documents),
lines AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM given),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^ 	-]') GROUP BY r),
windows AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS k FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM given WHERE len(w) >= 8)),
twice AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, k) > 1),
covered AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, i + j AS at FROM twice, range(0, 8) AS x(j)) GROUP BY r),
base AS (
  SELECT r, doc_id, lang, t, v, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(len(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM given LEFT JOIN dup USING (r) LEFT JOIN covered USING (r)),
judged AS (SELECT *, n_words < {divergence_rules.MIN_WORDS} OR 100 * n_repeat_words > {divergence_rules.REPEATED_PERCENT} * n_words AS base_failed FROM base),
chars AS (SELECT r, lang, base_failed, [{", ".join(f"length(t) - length(regexp_replace(t, '{c}', '', 'g'))" for c in _CLASSES)}] AS c FROM judged),
langs AS (SELECT lang FROM documents WHERE lang IS NOT NULL GROUP BY lang ORDER BY count(*) DESC, lang LIMIT {divergence_rules.LANGUAGES}),
spread AS (SELECT r, lang, base_failed, generate_subscripts(c, 1) AS k, unnest(c) AS n FROM chars),
class_sums AS (SELECT lang, k, sum(n) AS n FROM spread WHERE NOT base_failed AND lang IN (SELECT lang FROM langs) GROUP BY lang, k),
class_ref AS (SELECT lang, k, n / sum(n) OVER (PARTITION BY lang) AS q FROM class_sums),
words AS (SELECT r, lang, base_failed, unnest(v) AS x FROM judged),
counts AS (SELECT lang, x, count(*) AS n FROM words WHERE NOT base_failed AND lang IN (SELECT lang FROM langs) GROUP BY lang, x),
ranked AS (SELECT *, sum(n) OVER (PARTITION BY lang) AS total, row_number() OVER (PARTITION BY lang ORDER BY n DESC) AS place FROM counts),
word_ref AS (
  SELECT ranked.lang, x, n / total AS q FROM ranked LEFT JOIN (SELECT lang, n AS limit_n FROM ranked WHERE place = {divergence_rules.COMMON + 1}) AS l ON l.lang = ranked.lang WHERE n > coalesce(limit_n, 0)),
rest_ref AS (SELECT class_langs.lang, 1 - coalesce(sum(q), 0) AS q FROM (SELECT DISTINCT lang FROM class_ref) AS class_langs LEFT JOIN word_ref ON word_ref.lang = class_langs.lang GROUP BY class_langs.lang),
by_class AS (
  SELECT s.r, f.lang, sum(s.n) AS size, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2 AS d
  FROM (SELECT r, k, n, CAST(n AS DOUBLE) / greatest(sum(n) OVER (PARTITION BY r), 1) AS p FROM spread) AS s JOIN class_ref AS f USING (k) GROUP BY s.r, f.lang),
own AS (SELECT r, x, count(*) AS n FROM words GROUP BY r, x),
shares AS (SELECT j.r, f.lang, f.x, f.q, coalesce(own.n, 0) / greatest(j.n_words, 1) AS p, coalesce(own.n, 0) AS n FROM judged AS j CROSS JOIN word_ref AS f LEFT JOIN own ON own.r = j.r AND own.x = f.x),
parts AS (
  SELECT r, lang, sum(n) AS hits, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + q * log2(q / ((p + q) / 2))) AS d FROM shares GROUP BY r, lang),
by_word AS (
  SELECT j.r, e.lang, (coalesce(d, 0) + CASE WHEN u > 0 THEN u * log2(u / ((u + e.q) / 2)) ELSE 0 END + CASE WHEN e.q > 0 THEN e.q * log2(e.q / ((u + e.q) / 2)) ELSE 0 END) / 2 AS d
  FROM (SELECT j.r, e.lang, (j.n_words - coalesce(p.hits, 0)) / greatest(j.n_words, 1) AS u, p.d, e.q FROM judged AS j CROSS JOIN rest_ref AS e LEFT JOIN parts AS p ON p.r = j.r AND p.lang = e.lang) AS j JOIN rest_ref AS e ON e.lang = j.lang),
nearest AS (
  SELECT r, c.size, sqrt(greatest(c.d, 0)) AS a, sqrt(greatest(w.d, 0)) AS b FROM by_class AS c JOIN by_word AS w USING (r, lang)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY sqrt(greatest(c.d, 0)) + sqrt(greatest(w.d, 0)), lang) = 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed
  AND (size IS NULL OR size < {divergence_rules.GUARD_CHARS} OR sqrt(greatest(a * a - {len(divergence_rules.CLASSES) - 1} / (8 * ln(2) * size), 0)) <= {divergence_rules.CLASS_LIMIT})
  AND (size IS NULL OR n_words < {divergence_rules.GUARD_WORDS} OR sqrt(greatest(b * b - {divergence_rules.COMMON} / (8 * ln(2) * n_words), 0)) <= {divergence_rules.WORD_LIMIT}) AS kept
FROM judged LEFT JOIN nearest USING (r)"""


@_query
def op4_hyperminhash(spark: SparkSession, sf: str) -> DataFrame:
    return hyperminhash.near_duplicates(table(spark, sf, "documents"))


@_query
def op8_crf(spark: SparkSession, sf: str) -> DataFrame:
    docs, held = table(spark, sf, "documents"), bit_of_id("doc_id", 4) == 2
    return crf_langid.predict(docs, crf_langid.fit(docs, ~held)).select("doc_id", held.alias("held_out"), "lang_pred", "score")


@_query
def op9_brown_lm(spark: SparkSession, sf: str) -> DataFrame:
    return brown_lm.score(table(spark, sf, "documents"), bit_of_id("doc_id", 7) == 2)


@_query
def lm_base_counts(spark: SparkSession, sf: str) -> DataFrame:
    """What query 9 says beside its model's score, which SQL cannot say."""
    found = brown_lm.score(table(spark, sf, "documents"), bit_of_id("doc_id", 7) == 2)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 3).alias("base_score"))


ORACLES["lm_base_counts"] = rf"""
WITH RECURSIVE crc_table AS (
  SELECT i, i AS c, 0 AS step FROM range(0, 256) AS x(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, step + 1 FROM crc_table WHERE step < 8),
bits AS (SELECT list(c ORDER BY i) AS t FROM crc_table WHERE step = 8),
given AS (SELECT row_number() OVER () AS r, doc_id, {_SPLIT.format(_LOWERED)} AS w FROM documents),
marked AS (
  SELECT r, doc_id, w, coalesce(xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
    lambda crc, b: xor(crc >> 8, t[1 + (xor(crc, b) & 255)])), 4294967295) % 7, 0) = 2 AS held_out FROM given, bits),
tokens AS (SELECT r, held_out, unnest(w) AS x FROM marked UNION ALL SELECT r, held_out, NULL FROM marked),
train AS (SELECT x, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY x),
size AS (SELECT coalesce(sum(c), 0) AS n, count(*) AS v FROM train),
sums AS (
  SELECT tokens.r, count(*) AS n_tokens, count(c) AS n_known, sum(log10((coalesce(c, 0) + 1) / (SELECT n + v + 1 FROM size))) AS s
  FROM tokens LEFT JOIN train ON train.x IS NOT DISTINCT FROM tokens.x GROUP BY tokens.r)
SELECT doc_id, held_out, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(n_known AS BIGINT) AS n_known, CAST((SELECT n FROM size) AS BIGINT) AS train_tokens, round(s, 3) AS base_score
FROM marked JOIN sums USING (r)"""


@_query
def op10_hyperplanes(spark: SparkSession, sf: str) -> DataFrame:
    return hyperplane_dedup.near_duplicates(table(spark, sf, "embeddings"))


ORACLES["op10_hyperplanes"] = r"""
WITH RECURSIVE good AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95),
reach(r, t) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.r, links.b FROM reach JOIN links ON links.a = reach.t),
least AS (SELECT r, min(t) AS m FROM reach GROUP BY r),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, m AS component_id, m = vec_id AS kept
FROM embeddings JOIN least ON r = vec_id LEFT JOIN degree ON a = vec_id"""

ORACLES["op4_hyperminhash"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
one AS (SELECT min(doc_id) AS r, list_sort(s) AS s FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)),
items AS (SELECT r, unnest(s) AS x FROM one),
common AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM items a JOIN items b ON a.x = b.x AND a.r < b.r GROUP BY a.r, b.r),
links AS (
  SELECT a, b FROM common JOIN one p ON p.r = a JOIN one q ON q.r = b WHERE 100 * c >= 75 * (len(p.s) + len(q.s) - c)),
near AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(r, t) AS (SELECT r, r FROM one UNION SELECT reach.r, near.b FROM reach JOIN near ON near.a = reach.t),
least AS (SELECT r, min(t) AS m FROM reach GROUP BY r)
SELECT sets.doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, coalesce(m, sets.doc_id) AS component_id, coalesce(m, sets.doc_id) = sets.doc_id AS kept
FROM sets LEFT JOIN one ON one.s = list_sort(sets.s) LEFT JOIN least ON least.r = one.r"""
