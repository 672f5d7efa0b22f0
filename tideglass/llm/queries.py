"""The corpus operators over the whole tables of a folder: queries() and oracle_sql() in the form of __spark_entry__.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.llm import decontamination, license_scan, mixing, quality, sharding, simhash, token_store, tokens, toxicity, url_filter
from tideglass.llm.common import table

#: The rules of the url filter query (host, path, verdict), word for word as its contract lists them.
CONTRACT_URL_RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
#: The rules in OP4_SQL, which is left as it was given: it blocks net/de/, which the contract allows, so on the rows of that rule the query and its SQL differ.
URL_RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "block"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan.digest(license_scan.license_spans(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.stored_tokens(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages"), url_filter.rules_frame(spark, CONTRACT_URL_RULES))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("_key")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # The cascade judges raw texts and stops at a rule that rejects; the contract's measures of every row stand beside it.
    out = quality.measured(quality.cascade(docs, quality.text_rules(F.col("text"))))
    few, repeated = quality.base_rules(F.col("n_words"), F.col("n_repeat_words"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (few.rejects | repeated.rejects).alias("base_failed"), "kept")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.REJECT).cast("int").alias("predicted"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.ring_shards(table(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("_row.doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").alias("taken"))


QUERIES = {f.__name__: f for f in (op1_license_scans, op2_token_counts, op3_token_store, op4_url_filters, op5_decontamination, op6_quality_rules, op7_toxicity, op8_simhash, op9_sharding, op10_mixing)}

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP4_SQL = f"""
WITH u AS (SELECT row_number() OVER () AS k, page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT k, page_id, {_LOW.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rhost, rpath, rverdict) AS (VALUES {", ".join(repr(r) for r in URL_RULES)}),
m AS (SELECT k, rhost || rpath AS rule, rverdict, row_number() OVER (PARTITION BY k ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS n
      FROM h JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict FROM h LEFT JOIN (SELECT * FROM m WHERE n = 1) b ON h.k = b.k
"""

OP6_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
g AS (SELECT k, p, list_slice(w, p, p + 4) AS g FROM (SELECT k, w, unnest(range(1, len(w) - 3)) AS p FROM d WHERE len(w) >= 5)),
t AS (SELECT k, g FROM g GROUP BY k, g HAVING count(*) > 1),
c AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest(range(p, p + 5)) AS p FROM g JOIN t USING (k, g)) GROUP BY k),
l AS (SELECT k, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines FROM d JOIN l USING (k) LEFT JOIN c USING (k)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols * 10 > n_words OR n_dup_lines * 2 > n_lines OR word_chars < n_words * 2 OR word_chars > n_words * 16) AS kept FROM b
"""

OP10_SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size, md5('42:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM d GROUP BY source),
o AS (SELECT *, 2 * source_size AS cap, row_number() OVER (ORDER BY 2 * source_size / CAST(w AS DOUBLE), source NULLS LAST) AS k FROM s),
q AS (SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total, CAST(sum(cap) OVER (ORDER BY k) - cap AS BIGINT) AS capped, CAST(sum(w) OVER (ORDER BY k DESC) AS BIGINT) AS rest FROM o),
r AS (SELECT *, (1.5::DOUBLE * total - capped) / rest AS rate FROM q),
f AS (SELECT min(k) AS k0, arg_min(rate, k) AS rate0 FROM r WHERE rate * w <= cap),
t AS (SELECT source, source_size, CASE WHEN k0 IS NULL OR k < k0 THEN CAST(cap AS DOUBLE) ELSE rate0 * w END AS target FROM r, f),
b AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS budget FROM t),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM b),
x AS (SELECT doc_id, size, source_size, target, epochs, budget - epochs * source_size AS rest,
        CAST(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS before
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM x
"""

ORACLES = {"op4_url_filters": OP4_SQL, "op6_quality_rules": OP6_SQL, "op10_mixing": OP10_SQL}


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
