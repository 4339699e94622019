"""The queries opN_<name> over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfold.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfold.llm.sentencepiece_codec import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfold.llm.simhash_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfold.llm.language_id import identify

    return identify(table(spark, sf_dir, "documents"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfold.llm.fingerprints import fingerprint_documents, with_neighbours

    return with_neighbours(fingerprint_documents(table(spark, sf_dir, "documents")))


def op6_hpylm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfold.llm.hpylm import score

    return score(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfold.llm.exact_dedup import deduplicate

    return deduplicate(table(spark, sf_dir, "documents"))


def op8_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfold.llm.html_layout import extract_pages

    return extract_pages(table(spark, sf_dir, "pages"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfold.llm.url_filter import judge

    return judge(table(spark, sf_dir, "pages"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfold.llm.license_scan import scan

    return scan(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2:3].isdigit()}


ORACLE: dict[str, str] = {
    "op9_url_filter": """
WITH s AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(verdict, rh, rp) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
f AS (
  SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(verdict, length(rh || rp)) AS verdict
  FROM s JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT s.page_id, host, path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM s LEFT JOIN f USING (page_id)""",

    "op7_exact_dedup": """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, length(text) AS c, sha256(translate(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS h FROM t),
k AS (SELECT *, first_value(doc_id) OVER (PARTITION BY h ORDER BY c DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM k""",
}


def oracle_sql() -> dict[str, str]:
    from wayfold.llm import license_scan

    return ORACLE | {"op10_license_scan": license_scan.oracle_sql()}
