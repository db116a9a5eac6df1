"""The registered queries of this subpackage and the SQL they are held against.

``base_*`` are what the base patterns and counts of op5, op6 and op7 find, as queries of their own: SQL can express those. It can express
neither the tokenizers and file formats of op1, op2 and op8, nor the hash of op4, the models of op5 to op7, or the tree reading of op9.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import chat, decontaminate, extract, packing, pii, quality, secrets, simhash, token_files, warc
from graphloom.llm.decontaminate import MIN_ITEMS, WINDOW


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def _counts(scanned: DataFrame, base: str, kinds: list[str]) -> DataFrame:
    count = lambda k: F.size(F.filter(base, lambda x: x["k"] == k)).cast("long")
    return scanned.select("doc_id", *(count(k).alias(f"n_{name}") for k, name in enumerate(kinds)))


def base_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(pii.scan(_documents(spark, sf_dir)), "_p_base", pii.KINDS)


def base_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(secrets.scan(_documents(spark, sf_dir)), "_s_base", secrets.KINDS[:3])


def base_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = quality.text_stats(_documents(spark, sf_dir)).withColumn("base_failed", quality.base_failed())
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_formatting": chat.op1,
    "op2_best_fit_packing": packing.op2,
    "op3_warc_packages": warc.op3,
    "op4_simhash_near_dedup": simhash.op4,
    "op5_personal_data": pii.op5,
    "op6_quality_rules": quality.op6,
    "op7_secret_scans": secrets.op7,
    "op8_orc_token_ids": token_files.op8,
    "op9_html_extraction": extract.op9,
    "op10_decontamination": decontaminate.op10,
    "base_personal_data": base_personal_data,
    "base_secrets": base_secrets,
    "base_quality": base_quality,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER.format('''coalesce(text, '')''')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_DIGITS = "regexp_replace(x, '[^0-9]', '', 'g')"
_LUHN = f"list_sum([CASE WHEN i % 2 = 1 THEN c::INT WHEN c::INT > 4 THEN 2 * c::INT - 9 ELSE 2 * c::INT END FOR c, i IN string_split(reverse({_DIGITS}), '')]) % 10 = 0"

ORACLE_SQL: dict[str, str] = {
    "op3_warc_packages": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS largest FROM pages)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN strlen(h) >= 1000 AND page_id < largest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN strlen(h) >= 1000 AND page_id < largest THEN largest END::DOUBLE AS refers_to
FROM p""",
    "op10_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS ws FROM benchmark),
wins AS (SELECT DISTINCT item, least({WINDOW}, len(ws)) AS l, array_to_string(ws[i:i + least({WINDOW}, len(ws)) - 1], ' ') AS w FROM (SELECT *, unnest(range(1, greatest(1, len(ws) - {WINDOW - 1}) + 1)) AS i FROM b WHERE len(ws) > 0)),
probe AS (SELECT doc_id, l, i, array_to_string(ws[i:i + l - 1], ' ') AS w FROM (SELECT doc_id, ws, l, unnest(range(1, len(ws) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM wins) WHERE len(ws) >= l)),
met AS (SELECT doc_id, item, probe.i, probe.l FROM probe JOIN wins USING (l, w)),
hit AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + l)) AS k FROM met) GROUP BY 1),
own AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM met) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(own.n, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(own.n, 0) >= {MIN_ITEMS} AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN own USING (doc_id)""",
    "base_personal_data": rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'))::BIGINT AS n_email,
  len([x FOR x IN regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') IF list_bool_and([coalesce(try_cast(y AS HUGEINT) <= 255, FALSE) FOR y IN string_split(x, '.')])])::BIGINT AS n_ip,
  len([x FOR x IN regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+') IF CASE WHEN length({_DIGITS}) BETWEEN 16 AND 19 THEN {_LUHN} ELSE FALSE END])::BIGINT AS n_card,
  len([x FOR x IN regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]') IF length({_DIGITS}) BETWEEN 8 AND 15])::BIGINT AS n_phone
FROM t""",
    "base_secrets": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, len([x FOR x IN regexp_extract_all(t, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1) IF length(x) >= 8])::BIGINT AS n_assign,
  len([x FOR x IN regexp_extract_all(t, 'AKIA[A-Z0-9]+') IF length(x) >= 16])::BIGINT AS n_access, len([x FOR x IN regexp_extract_all(t, '[0-9a-f]+') IF length(x) >= 32])::BIGINT AS n_hex
FROM t""",
    "base_quality": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d WHERE len(ws) >= 8)),
rep AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS k FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, w) AS c FROM win) WHERE c > 1) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(n, 0)::BIGINT AS n_repeat_words, len(ws) < 20 OR 100 * coalesce(n, 0) > 30 * len(ws) AS base_failed
FROM d LEFT JOIN rep USING (doc_id)""",
}
