"""Queries opN_<name> over the synthetic tables, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontam, linededup, probminhash, quality_model, quality_rules, secrets, sharding, tokencount, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(_table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(_table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.report(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.report(_table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.report(_table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(_table(spark, sf_dir, "pages"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokencount.report(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probminhash.report(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_decontamination, op2_line_dedup, op3_secret_scan, op4_byte_bpe, op5_quality_rules, op6_sharding, op7_warc, op8_token_counts, op9_quality_classifier, op10_near_dedup, pipeline]
    return {f.__name__: f for f in own}


_UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP1_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_UPPER}), '{_WORD}') AS w FROM documents),
     b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, regexp_extract_all(translate(coalesce(text, ''), {_UPPER}), '{_WORD}') AS w FROM benchmark),
     bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS win
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
     sizes AS (SELECT DISTINCT n FROM bw),
     dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
     hits AS (SELECT doc_id, dw.n, i, item_id FROM dw JOIN bw USING (n, win)),
     hit_words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hits) GROUP BY doc_id),
     items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP2_SQL = rf"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
     k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {_UPPER}) AS key FROM l),
     f AS (SELECT *, length(key) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY key) AS gone FROM k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""

_BIN = "r - r % (CAST(1 AS BIGINT) << greatest(length(bin(r)) - 6, 0))"


def _quartiles(level: str) -> str:
    """The quartiles of sketches s merged to these columns, of groups that are large and spread enough."""
    by = ", ".join(filter(None, [level, "rule"]))
    return f"""(SELECT {by}, q1, q3 FROM (SELECT {by}, any_value(total) AS total, min(bin) FILTER (WHERE 4 * upto >= total) AS q1, min(bin) FILTER (WHERE 4 * upto >= 3 * total) AS q3
        FROM (SELECT *, sum(n) OVER (PARTITION BY {by} ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY {by}) AS total FROM (SELECT {by}, bin, sum(n) AS n FROM s GROUP BY {by}, bin)) GROUP BY {by}) WHERE total >= {quality_rules.LEAST} AND q1 < q3)"""


OP5_SQL = rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
     lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
     win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
     again AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
     rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM again) GROUP BY doc_id),
     m AS (SELECT d.doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
                  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
           FROM d JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
     r AS (SELECT *, 100000 * (n_symbols + 1) // (word_chars + 1) AS h1, 1000 * (n_dup_lines + 1) // (n_lines + 1) AS h2, 100 * word_chars // nullif(n_words, 0) AS h3,
                  100000 * n_symbols // nullif(word_chars, 0) AS r1, 1000 * n_dup_lines // nullif(n_lines, 0) AS r2 FROM m),
     s AS (SELECT lang, source, rule, {_BIN} AS bin, count(*) AS n
           FROM (SELECT lang, source, unnest([1, 2, 3]) AS rule, unnest([h1, h2, h3]) AS r FROM r WHERE n_words > 0) GROUP BY ALL),
     q AS (SELECT k.lang, k.source, k.rule, coalesce(a.q1, b.q1, c.q1) AS q1, coalesce(a.q3, b.q3, c.q3) AS q3 FROM (SELECT DISTINCT lang, source, rule FROM s) AS k
           LEFT JOIN {_quartiles("lang, source")} AS a ON k.lang IS NOT DISTINCT FROM a.lang AND k.source IS NOT DISTINCT FROM a.source AND k.rule = a.rule
           LEFT JOIN {_quartiles("lang")} AS b ON k.lang IS NOT DISTINCT FROM b.lang AND k.rule = b.rule
           LEFT JOIN {_quartiles("")} AS c ON k.rule = c.rule),
     most AS (SELECT lang, source, max(q3 + {quality_rules.SPREAD["symbols"]} * (q3 - q1)) FILTER (WHERE rule = 1) AS m1, max(q3 + {quality_rules.SPREAD["dup_lines"]} * (q3 - q1)) FILTER (WHERE rule = 2) AS m2,
                     max(q3 + {quality_rules.SPREAD["word_length"]} * (q3 - q1)) FILTER (WHERE rule = 3) AS m3, max(q1 - {quality_rules.SPREAD["word_length"]} * (q3 - q1)) FILTER (WHERE rule = 3) AS l3 FROM q GROUP BY ALL)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND coalesce(r1 <= m1, TRUE) AND coalesce(r2 <= m2, TRUE) AND coalesce(h3 BETWEEN l3 AND m3, TRUE) AS kept
FROM r LEFT JOIN most ON r.lang IS NOT DISTINCT FROM most.lang AND r.source IS NOT DISTINCT FROM most.source
"""

OP6_SQL = """
WITH tbl AS (SELECT list(c ORDER BY i) AS t FROM (
       SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) AS c FROM (SELECT unnest(range(256)) AS i))),
     k AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, md5(coalesce(text, '')) AS key,
                  xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(strlen(coalesce(text, ''))), lambda i: CAST(('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2)) AS BIGINT))),
                      lambda c, x: xor(c // 256, t[CAST(xor(c, x) % 256 + 1 AS BIGINT)])), 4294967295) AS text_crc32
           FROM (SELECT *, hex(encode(coalesce(text, ''))) AS h FROM documents), tbl),
     o AS (SELECT *, sum(size) OVER (ORDER BY key, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS total, row_number() OVER (ORDER BY key, doc_id NULLS FIRST) AS i FROM k),
     s AS (SELECT *, least((2 * upto - size) * 8 // (2 * total), 7) AS shard FROM o)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard,
       CAST(row_number() OVER (PARTITION BY shard ORDER BY i) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM s
"""

OP7_SQL = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
     b AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS best FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN best = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN best <> page_id THEN best END AS refers_to
FROM b
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": OP1_SQL, "op2_line_dedup": OP2_SQL, "op5_quality_rules": OP5_SQL, "op6_sharding": OP6_SQL, "op7_warc": OP7_SQL}
