"""The corpus operators as queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .decontam import decontaminate
from .exact_dedup import exact_dedup
from .html_main import extract_main_text
from .langid import identify_languages
from .licenses import scan_licenses
from .line_dedup import clean_lines
from .near_dup import near_duplicates
from .packing import pack_tokens
from .sharding import shard_by_bytes
from .token_counts import token_counts


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = clean_lines(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontamination, op2_exact_dedup, op3_token_counts, op4_language_id, op5_license_scan, op6_packing, op7_html_extraction, op8_sharding, op9_line_dedup, op10_near_dup)}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER copies AS keep_id, count(*) OVER copies AS group_size,
                   doc_id = max(doc_id) OVER copies AS kept, sha256(coalesce(text, '')) AS text_sha256
            FROM documents WINDOW copies AS (PARTITION BY coalesce(text, ''))""",
        "op10_near_dup": """
            WITH RECURSIVE worded AS (
                SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
            ), sets AS (
                SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
                                    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM worded
            ), each AS (
                SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
            ), links AS (
                SELECT a.doc_id AS a, b.doc_id AS b FROM each a JOIN each b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
                GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
            ), reached AS (
                SELECT doc_id, doc_id AS other FROM documents
                UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON r.other = l.a
            )
            SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.component_id, s.doc_id = r.component_id AS kept
            FROM sets s JOIN (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id) r USING (doc_id)""",
        "op9_line_dedup": """
            WITH lines AS (
                SELECT doc_id, source, n, line, md5(trim(line, ' ')) AS key, trim(line, ' ') <> '' AS solid
                FROM (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                             generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents)
            ), spread AS (
                SELECT key FROM lines WHERE solid GROUP BY key HAVING count(DISTINCT source) >= 8
            )
            SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
                   md5(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '')) AS text_md5
            FROM (SELECT *, solid AND key IN (SELECT key FROM spread) AS gone FROM lines)
            GROUP BY doc_id""",
    }
