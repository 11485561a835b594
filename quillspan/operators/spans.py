"""Sessionization: runs of lines that share an id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sessionize(rows: DataFrame, group: str = "doc_id", order: str = "lineno", value: str = "span_id") -> DataFrame:
    """Rows whose ``value`` is not null, with ``span_ord``: 1, 2, ... for each maximal run of equal values in a group.

    A value that comes back after a gap starts another span. Two windows of one partitioning: one shuffle.
    """
    w = Window.partitionBy(group).orderBy(order)
    new = F.col(value).isNotNull() & ~F.col(value).eqNullSafe(F.lag(value).over(w))
    return rows.withColumn("_new", new.cast("int")).withColumn("span_ord", F.sum("_new").over(w).cast("int")).where(F.col(value).isNotNull()).drop("_new")


def span_bounds(spans: DataFrame, group: str = "doc_id", order: str = "lineno") -> DataFrame:
    return spans.groupBy(group, "span_ord").agg(F.min(order).alias("top"), F.max(order).alias("bottom"))
