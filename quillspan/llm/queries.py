"""The queries of the corpus operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .editprint import fingerprint_with_edits
from .embeddings import embedding_components
from .extract import extract_main_text
from .licences import scan_licences
from .mixing import mix_sources, mixing_sql
from .packing import pack
from .quality import score_quality
from .shared import call_scope, small_batches
from .simhash import simhash_components
from .substring import drop_repeated
from .urlrules import PRODUCTION_RULES, judge_urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file() -> str:
    """Where the public word-level BPE lies; it is read in place."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_file())


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(PRODUCTION_RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


def op3_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_with_edits(table(spark, sf_dir, "documents"))


#: Wanted weights of the sources; all others have weight 1.
TARGET = {"src0": 2.0, "src1": 3.0, "src2": 0.5, "src3": 1.5}


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars"), TARGET)


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(table(spark, sf_dir, "embeddings"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


Query = Callable[[SparkSession, str], DataFrame]


def tidy(f: Query) -> Query:
    """Tables that the last but one call of the query has written are deleted."""

    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with call_scope(spark, f.__name__):
            return f(spark, sf_dir)

    return run


QUERIES: dict[str, Query] = {
    "op1_packing": tidy(op1_packing),
    "op2_url_rules": tidy(op2_url_rules),
    "op3_edit_fingerprints": tidy(op3_edit_fingerprints),
    "op4_mixing": tidy(op4_mixing),
    "op5_licences": tidy(op5_licences),
    "op6_main_text": tidy(op6_main_text),
    "op7_simhash": tidy(op7_simhash),
    "op8_substrings": tidy(op8_substrings),
    "op9_embeddings": tidy(op9_embeddings),
    "op10_quality": tidy(op10_quality),
}

_RULES_SQL = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in PRODUCTION_RULES)

ORACLES: dict[str, str] = {
    "op9_embeddings": """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, e, len(e) AS d, sqrt(list_inner_product(e, e)) AS norm FROM v),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.d = b.d AND a.vec_id <> b.vec_id WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.95),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(low.b, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(low.b, vec_id)) AS kept
FROM embeddings LEFT JOIN low ON low.a = vec_id LEFT JOIN n ON n.a = vec_id
""",
    "op4_mixing": mixing_sql(TARGET, 1.0, 1.0, "mix"),
    "op2_url_rules": rf"""
WITH parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*(/[^?#]*)', 1), '') AS path
  FROM pages),
rules(rh, rp, v) AS (VALUES {_RULES_SQL}),
fits AS (
  SELECT page_id, host, path, rh || rp AS rule, v,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC, length(rh) DESC, v DESC) AS r
  FROM parts JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.v, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON p.page_id = f.page_id AND f.r = 1
""",
}
