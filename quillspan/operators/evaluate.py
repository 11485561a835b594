"""Accuracy, recall and confusion of predictions against the truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def common_codes(spans_l: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """``(name, code)``: the code most often used with a name (ties: the lower); a name's only code if it is not seen.

    ``spans_l`` are language lines (lang_name, lang_code); codes joined by a colon count each.
    """
    seen = spans_l.select(F.coalesce(F.lower("lang_name"), F.lit("???")).alias("name"), F.explode(F.split(F.coalesce("lang_code", F.lit("und")), ":")).alias("code"))
    top = seen.groupBy("name", "code").agg(F.count("*").alias("n")).groupBy("name").agg(F.min_by("code", F.struct(-F.col("n"), "code")).alias("code"))
    lone = gazetteer.groupBy("name").agg(F.count_distinct("code").alias("k"), F.min("code").alias("only"))
    return lone.join(top, "name", "left").where("code is not null or k = 1").select("name", F.coalesce("code", "only").alias("code"))


def compared(truth: DataFrame, predicted: DataFrame, key: list[str]) -> DataFrame:
    """Truth (gold_name, gold_code) with the prediction (name, code) of the same line, if there is one."""
    return truth.join(predicted.select(*key, "name", "code"), key, "left").withColumns({
        "right_name": F.coalesce(F.col("gold_name") == F.col("name"), F.lit(False)), "right_code": F.coalesce(F.col("gold_code") == F.col("code"), F.lit(False))}).withColumn(
        "right_both", F.col("right_name") & F.col("right_code"))


def accuracy(c: DataFrame, by: list[str] | None = None) -> DataFrame:
    mean = lambda x: F.avg(F.col(x).cast("int"))
    return c.groupBy(*(by or [])).agg(F.count("*").alias("samples"), mean("right_name").alias("acc_name"), mean("right_both").alias("acc_both"), mean("right_code").alias("acc_code"))


def per_language(c: DataFrame) -> DataFrame:
    return c.where("name is not null").groupBy("gold_name", "gold_code").agg(F.sum(F.col("right_both").cast("long")).alias("n_right"), F.count("*").alias("n_total"))


def confusion(c: DataFrame) -> DataFrame:
    """Wrong predictions by (real, predicted), the most frequent first."""
    return c.where("name is not null and not right_both").groupBy("gold_name", "gold_code", "name", "code").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "gold_name", "gold_code", "name", "code")


def mention_recall(truth: DataFrame, mentions: DataFrame) -> DataFrame:
    """The share of true (doc_id, gold_name, gold_code) rows that are mentioned in their document; 1 without any."""
    m = mentions.select("doc_id", F.col("name").alias("gold_name"), F.col("code").alias("gold_code"), F.lit(1).alias("hit")).distinct()
    return truth.join(m, ["doc_id", "gold_name", "gold_code"], "left").agg(F.coalesce(F.sum(F.coalesce("hit", F.lit(0))) / F.nullif(F.count("*"), F.lit(0)), F.lit(1.0)).alias("recall"))


def fold_summary(folds: DataFrame) -> DataFrame:
    """Means and population deviations over folds of (acc_name, acc_both, acc_code, recall)."""
    cols = [x for x in ("acc_name", "acc_both", "acc_code", "recall") if x in folds.columns]
    return folds.agg(*[f(x).alias(f"{n}_{x}") for x in cols for n, f in (("mean", F.avg), ("std", F.stddev_pop))])
