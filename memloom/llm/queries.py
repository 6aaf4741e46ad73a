"""Queries of the training-data operators over the whole driver tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .decontam import contamination
from .html_text import main_text
from .mixture import mix
from .pii import personal_data
from .quality import quality_rules
from .repeats import repeated_text
from .simhash import simhash_components
from .token_counts import token_counts
from .toxicity import toxicity
from .warc import warc_round_trip


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark, table(spark, sf_dir, "pages"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(spark, table(spark, sf_dir, "documents"))


def op7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark, table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(spark, table(spark, sf_dir, "pages"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_text(spark, table(spark, sf_dir, "documents"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_html_text": op2_html_text,
        "op3_token_counts": op3_token_counts,
        "op4_quality_rules": op4_quality_rules,
        "op5_decontamination": op5_decontamination,
        "op6_simhash": op6_simhash,
        "op7_mixture": op7_mixture,
        "op8_warc": op8_warc,
        "op9_repeats": op9_repeats,
        "op10_personal_data": op10_personal_data,
    }


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Runs of 13 words (fewer for shorter items) of the benchmark, met with all runs of the documents.
CONTAMINATION = f"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents), b AS (SELECT DISTINCT coalesce(item_id::VARCHAR, '') AS item, {_WORDS} AS w FROM benchmark),
 bl AS (SELECT item, w, least(len(w), 13) AS k FROM b WHERE len(w) > 0), bg AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS run FROM (SELECT item, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM bl)),
 ks AS (SELECT DISTINCT k FROM bg), dg AS (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS run FROM (SELECT r, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
 hit AS (SELECT r, k, i, item FROM dg JOIN bg USING (k, run)), n AS (SELECT r, count(DISTINCT at_) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS at_ FROM hit) GROUP BY r),
 it AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
 SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
 FROM d LEFT JOIN n USING (r) LEFT JOIN it USING (r)"""

WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), q AS (SELECT *, strlen(html) AS n, max(page_id) OVER (PARTITION BY html) AS last FROM p)
 SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to FROM q"""

#: All 50-byte strings, as 100 hexadecimal digits, and the smallest document of each.
REPEATS = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS p FROM d)),
 r AS (SELECT s, min(doc_id) AS m FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)), g AS (SELECT DISTINCT doc_id, p FROM w JOIN r USING (s) WHERE doc_id > m),
 x AS (SELECT doc_id, p, coalesce(p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50, true)::INT AS new_ FROM g), y AS (SELECT *, sum(new_) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM x),
 sp AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS z FROM y GROUP BY doc_id, run), sl AS (SELECT *, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM sp),
 k AS (SELECT doc_id, count(*) AS n_spans, sum(z - a)::BIGINT AS n_removed, max(z) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head FROM sl JOIN d USING (doc_id) GROUP BY doc_id)
 SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(head || substr(h, 2 * last + 1), h))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    """Of the operators that SQL can express in full; tests hold the others against brute force."""
    return {"op5_decontamination": CONTAMINATION, "op8_warc": WARC, "op9_repeats": REPEATS}
