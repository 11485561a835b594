"""Scores of instances, the best candidate of each line, and annotation of spans with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def score(instances: DataFrame, weights: DataFrame, bias: float, keys: list[str]) -> DataFrame:
    """Adds ``p``, the probability of the label, from ``weights`` (feature, weight).

    Instances without features or with unknown ones keep the bias. The weights are a closed vocabulary of some 104
    rows; they come to every row as one map, so instances are neither worked out twice nor shuffled for their sums.
    """
    known = weights.where("feature is not null").groupBy("feature").agg(F.sum("weight").alias("weight"))
    table = known.agg(F.map_from_entries(F.collect_list(F.struct("feature", "weight"))).alias("_w"))
    z = F.aggregate("feats", F.lit(0.0), lambda a, f: a + F.coalesce(F.try_element_at("_w", f), F.lit(0.0)))
    return instances.crossJoin(F.broadcast(table)).withColumn("p", 1 / (1 + F.exp(-(F.lit(bias) + F.coalesce(z, F.lit(0.0)))))).drop("_w")


def signed(p: Column) -> Column:
    """The best class's probability, negative if that class is false; a tie goes to false."""
    return F.when(p > 0.5, p).otherwise(p - 1)


def best(scored: DataFrame, line: list[str]) -> DataFrame:
    """The best candidate of each line with its score scaled to 0..1 within the line; ties: first mentioned.

    If all scores of a line are equal, ``scaled`` is null and the first mentioned wins.
    """
    w = Window.partitionBy(*line)
    low, high = F.min("signed").over(w), F.max("signed").over(w)
    out = scored.withColumn("signed", signed(F.col("p"))).withColumn("scaled", (F.col("signed") - low) / F.nullif(high - low, F.lit(0.0)))
    first = F.row_number().over(w.orderBy(F.desc("p"), "cand_ord", "name", "code"))
    return out.withColumn("_r", first).where("_r = 1").drop("_r")


def carry_forward(lines: DataFrame, predictions: DataFrame, span: list[str], order: str = "lineno", values: tuple[str, ...] = ("name", "code")) -> DataFrame:
    """Each line gets the prediction of the last predicted line at or before it in its span; null before the first."""
    w = Window.partitionBy(*span).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = lines.join(predictions, [*span, order], "left")
    return met.withColumns({v: F.last(v, ignorenulls=True).over(w) for v in values})
