"""Fitting and applying the classifier of instances, with Spark ML."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, UnivariateFeatureSelector
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BIAS = "(bias)"


@dataclass(frozen=True)
class Model:
    """Weights of a closed vocabulary; ``weights[BIAS]`` is the bias."""

    weights: dict[str, float]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.weights.items()), "feature string, weight double")


def vocabulary(instances: DataFrame) -> list[str]:
    """All features, in order; a closed set of some hundred names whatever the input."""
    return sorted(r.feature for r in instances.select(F.explode("feats").alias("feature")).distinct().collect())


def train(instances: DataFrame, num_feats: int | None = None, tol: float = 1e-8) -> Model:
    """L2-regularised logistic regression (C = 1) whose bias is penalised like any other weight.

    A column of ones is the bias. As Spark gives a constant column no weight, one phantom row of weight 1e-6 lacks
    it. With ``num_feats`` the features are first cut to the best by the chi-squared test.
    """
    spark = instances.sparkSession
    words = vocabulary(instances)
    n, kinds = instances.agg(F.count("*"), F.count_distinct("label")).first()
    if kinds < 2:
        raise ValueError("training needs instances of both classes")
    if num_feats and num_feats < len(words):
        counts = CountVectorizerModel.from_vocabulary(words, inputCol="feats", outputCol="all")
        counts.setBinary(True)
        rows = counts.transform(instances.select("feats", F.col("label").cast("double").alias("y")))
        picked = UnivariateFeatureSelector(featuresCol="all", labelCol="y", selectionMode="numTopFeatures").setFeatureType("categorical").setLabelType("categorical").setSelectionThreshold(num_feats).fit(rows)
        words = [words[i] for i in sorted(picked.selectedFeatures)]
    vector = CountVectorizerModel.from_vocabulary([*words, BIAS], inputCol="f", outputCol="x")
    vector.setBinary(True)
    rows = vector.transform(instances.select(F.concat("feats", F.array(F.lit(BIAS))).alias("f"), F.col("label").cast("double").alias("y"))).select("x", "y", F.lit(1.0).alias("w"))
    phantom = spark.createDataFrame([(Vectors.sparse(len(words) + 1, {}), 0.0, 1e-6)], rows.schema)
    fit = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", regParam=1.0 / n, elasticNetParam=0.0, standardization=False, fitIntercept=False, tol=tol, maxIter=100).fit(rows.union(phantom))
    return Model(dict(zip([*words, BIAS], map(float, fit.coefficients))))


def predict(instances: DataFrame, model: Model) -> DataFrame:
    """Adds ``p``; features that the model does not know are ignored. Row by row, without a shuffle."""
    table = F.create_map(*[F.lit(x) for k, v in model.weights.items() if k != BIAS for x in (k, v)]) if len(model.weights) > 1 else None
    z = F.lit(model.weights.get(BIAS, 0.0))
    if table is not None:
        z = z + F.aggregate("feats", F.lit(0.0), lambda a, f: a + F.coalesce(F.try_element_at(table, f), F.lit(0.0)))
    return instances.withColumn("p", 1 / (1 + F.exp(-z)))


def weights(model: Model, spark: SparkSession) -> DataFrame:
    return model.table(spark).orderBy(F.desc("weight"), "feature")


def unused_features(spark: SparkSession, switches: tuple[str, ...], used: DataFrame) -> DataFrame:
    """Switches that no feature of a model answers to."""
    return spark.createDataFrame([(f,) for f in switches], "feature string").join(used.select("feature").distinct(), "feature", "left_anti")  # a few hundred names; rows of one would meet in one task


def save(model: Model, spark: SparkSession, path: str) -> None:
    model.table(spark).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Model:
    return Model({r.feature: r.weight for r in spark.read.parquet(path).collect()})
