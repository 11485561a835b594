"""A corpus pipeline of five stages, each one of the operators over all that its predecessor kept.

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes each result as Parquet in the shared
folder and rereads it as the next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.mixing import mix_sources
from quillspan.llm.packing import pack
from quillspan.llm.quality import keep_good
from quillspan.llm.queries import TARGET, table, tokenizer_file
from quillspan.llm.shared import materialize, release, scope, small_batches
from quillspan.llm.simhash import near_duplicate_groups
from quillspan.llm.substring import drop_repeated

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage(f: Stage) -> Stage:
    """Tables of the stage before are deleted when a stage begins: its result has been written by then."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        release(spark, "pipeline stage")
        with scope("pipeline stage"):
            return f(spark, docs.select(COLUMNS), sf_dir)

    return run_stage


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score under 0.3) go. Labels of held-out rows are not learnt from."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) one row stays, that with the smallest doc_id.

    Rows are told apart by id and text: rows with the same id and unrelated texts all stay, and rows without an id
    are grouped like any other and stay only if no row of their group has one.
    """
    _, groups = near_duplicate_groups(docs)
    # plain equal keys for join and dropDuplicates, so that texts are dealt once
    key = ["void", "id", "text_key"]
    row_id = [F.col("doc_id").isNull().alias("void"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), "text_key"]
    first = groups.select("first.doc_id", "first.text_key").select(row_id)
    keyed = docs.withColumn("text_key", F.xxhash64(F.coalesce(F.col("text").cast("binary"), F.lit(b"")))).select(*COLUMNS, *row_id)
    return keyed.join(first, key, "left_semi").dropDuplicates(key).select(COLUMNS)


@stage
def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that recur go; a text that loses none is unchanged. Every document stays."""
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    size = F.when(F.col("n_removed") > 0, F.char_length("kept").cast("long")).otherwise(F.col("n_chars"))
    return drop_repeated(docs).select("doc_id", text.alias("text"), "lang", "source", size.alias("n_chars"))


@stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated (0, 1, ... times) so that sources come to their target weights, in random order."""
    return mix_sources(docs, TARGET).select(COLUMNS)


@stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, a repeated document as often as it occurs, packed into sequences."""
    return pack(docs, tokenizer_file())


STAGES: list[tuple[str, Stage]] = [("quality", quality), ("near_duplicates", near_duplicates), ("passages", passages), ("mixing", mixing), ("packing", packing)]

#: Fingerprints, tokens and a fitted model are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    release(spark, "pipeline")
    for name, f in STAGES[:-1]:
        out = f(spark, docs, sf_dir)
        with scope("pipeline"):
            docs = materialize(out, name)
        release(spark, "pipeline", keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
