"""Mixing sources to target weights by Poisson replication, in DataFrame operations only.

A source's repetition rate is its target share of the total size over its own share. Each document's count is a
Poisson variate with that mean, got by inverting the distribution at a uniform number hashed from the seed and the
document's id: reruns, retries and other partitionings give the same counts. Documents are exploded by their counts
and shuffled globally by a hashed key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize

#: Rates above this are drawn as sums of equal parts, so that exp(-rate) stays far from zero.
PART = 500.0
#: Entries of all sources' distribution tables up to which they are broadcast (8 bytes each).
BROADCAST_ENTRIES = 1_000_000
#: Code points of a partition of the result, at most on average.
PARTITION_CHARS = 128_000_000


def uniform(*parts: Column | str) -> Column:
    """52 bits of an MD5 over the parts joined by colons, as a number in [0, 1)."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def repetition_rates(docs: DataFrame, weights: dict[str, float], default: float = 1.0, epochs: float = 1.0) -> DataFrame:
    """``(mixed, all_size, rate, parts, cdf)``: for each source the size of all texts, its mean count and the distribution function of a part of it.

    Sizes are code points of whole texts over all rows. Sources that ``weights`` does not name get ``default``;
    weights are normalised over the sources that occur. A source without any text has rate ``epochs``.
    """
    named = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else F.create_map().cast("map<string,double>")
    sizes = docs.groupBy(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("mixed")).agg(F.sum(F.coalesce(F.char_length("text"), F.lit(0)).cast("long")).alias("size"))
    sizes = sizes.withColumn("weight", F.coalesce(F.try_element_at(named, F.col("mixed")).cast("double"), F.lit(float(default))))
    total = sizes.agg(F.sum("size").alias("all_size"), F.sum(F.when(F.col("size") > 0, F.col("weight"))).alias("all_weight"))
    rate = F.when(F.col("size") > 0, F.lit(float(epochs)) * F.col("weight") / F.col("all_weight") * F.col("all_size") / F.col("size")).otherwise(F.lit(float(epochs)))
    rates = sizes.join(F.broadcast(total)).select("mixed", "all_size", rate.alias("rate"))  # total is one row
    rates = rates.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART).cast("int"))).withColumn("mean", F.col("rate") / F.col("parts"))
    return rates.selectExpr(
        "mixed", "all_size", "rate", "parts",
        """aggregate(sequence(1, cast(ceil(mean + 12 * sqrt(mean)) as int) + 30),
             named_struct('p', exp(-mean), 'cdf', array(exp(-mean))),
             (s, k) -> named_struct('p', s.p * mean / k, 'cdf', concat(s.cdf, array(s.cdf[k - 1] + s.p * mean / k))),
             s -> s.cdf) AS cdf""")  # fmt: skip


def mix_sources(docs: DataFrame, weights: dict[str, float], default: float = 1.0, epochs: float = 1.0, seed: str = "mix") -> DataFrame:
    """All columns of ``docs`` with ``copy`` (0, 1, ... for each document) and ``order_key``, shuffled globally.

    Rows with equal ids get equal counts; a null id counts as the text "null", a null source as the source "". Null
    and empty texts have size 0 and are replicated at their source's rate. Columns of any names are kept, but those
    named ``copy`` and ``order_key``, which are replaced. Partitions hold random parts of the result, each in random
    order (by ``order_key``). Empty in, empty out.

    Sizes are summed by partial aggregation; the rates go to the documents, not the documents to their source, so a
    source with a third of all rows is no hot key. Only if the rate tables are larger than a checked bound are both
    sides shuffled, in a join that AQE splits. The number of partitions follows the size of the result.
    """
    spark = docs.sparkSession
    rates = materialize(repetition_rates(docs, weights, default, epochs), "rates")
    entries, size = rates.agg(F.sum(F.size("cdf")), F.max("all_size")).first()
    kept = [c for c in docs.columns if c not in ("copy", "order_key")]
    # a document's columns travel as one struct, so no name of theirs meets a name used here
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept] or [F.lit(0).alias("none")]).alias("doc"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("mixed"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("key"))
    rates = F.broadcast(rates) if (entries or 0) <= BROADCAST_ENTRIES else rates
    draws = F.transform(F.sequence(F.lit(1), F.col("parts")), lambda i: uniform(F.lit(seed), F.col("key"), i.cast("string")))
    count = F.aggregate(draws, F.lit(0), lambda t, u: t + F.size(F.filter("cdf", lambda c: c <= u)))
    out = own.join(rates.select("mixed", "parts", "cdf"), "mixed").select("doc", "key", count.alias("n")).where("n > 0").select("doc", "key", F.explode(F.expr("sequence(0, n - 1)")).alias("copy"))
    out = out.select(*[F.col("doc").getField(c).alias(c) for c in kept], "copy", F.md5(F.concat_ws(":", F.lit(seed + "/order"), F.col("key"), F.col("copy").cast("string"))).alias("order_key"))
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(epochs * (size or 0)) // PARTITION_CHARS)
    return out.repartition(partitions, "order_key").sortWithinPartitions("order_key")


def mixing_sql(weights: dict[str, float], default: float, epochs: float, seed: str) -> str:
    """The same in DuckDB's SQL over ``documents``; the distribution function from log-gamma."""
    named = " ".join(f"WHEN '{k}' THEN {float(v)}" for k, v in weights.items())
    return f"""
WITH d AS (SELECT *, coalesce(source, '') AS mixed, coalesce(CAST(doc_id AS VARCHAR), 'null') AS k FROM documents),
sizes AS (SELECT mixed, sum(coalesce(length(text), 0)) AS size, CASE mixed {named} ELSE {float(default)} END AS w FROM d GROUP BY mixed),
totals AS (SELECT sum(size) AS all_size, sum(w) FILTER (size > 0) AS all_w FROM sizes),
rates AS (SELECT mixed, CASE WHEN size > 0 THEN {float(epochs)} * w / all_w * all_size / size ELSE {float(epochs)} END AS rate FROM sizes, totals),
parts AS (SELECT mixed, greatest(1, CAST(ceil(rate / {PART}) AS INT)) AS m, rate / greatest(1, CAST(ceil(rate / {PART}) AS INT)) AS mean FROM rates),
cdf AS (
  SELECT mixed, m, x, sum(exp(x * ln(mean) - mean - lgamma(x + 1))) OVER (PARTITION BY mixed ORDER BY x) AS c
  FROM parts, LATERAL (SELECT unnest(range(0, CAST(ceil(mean + 12 * sqrt(mean)) AS INT) + 31)) AS x)),
draws AS (
  SELECT d.*, i, ('0x' || substr(md5('{seed}:' || k || ':' || i), 1, 13))::BIGINT / pow(2, 52) AS u
  FROM d JOIN parts p ON d.mixed = p.mixed, LATERAL (SELECT unnest(range(1, m + 1)) AS i)),
counts AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, d.k, d.i, count(c.x) AS n FROM draws d LEFT JOIN cdf c ON d.mixed = c.mixed AND c.c <= d.u GROUP BY ALL),
summed AS (SELECT doc_id, text, lang, source, n_chars, k, CAST(sum(n) AS BIGINT) AS n FROM counts GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, CAST(copy AS INT) AS copy, md5('{seed}/order:' || k || ':' || copy) AS order_key
FROM summed, LATERAL (SELECT unnest(range(0, n)) AS copy)
"""
