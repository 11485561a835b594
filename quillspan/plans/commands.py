"""The jobs behind the command line, each one DataFrame plan from files to files or rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.text import has_tag
from ..operators import evaluate, learn, models, scoring
from ..operators.instances import LINE, gold, instances, vectors
from ..operators.mentions import count_mentions, mentions
from ..operators.spans import sessionize
from ..sources import annotated, resources


class Workbench:
    """Resources named by a configuration, read when they are first needed."""

    def __init__(self, spark: SparkSession, settings: Settings, places: dict[str, str]) -> None:
        self.spark, self.s, self.places = spark, settings, places
        self._kept: dict[tuple[str, ...], DataFrame] = {}

    def close(self) -> None:
        """Give back the mentions that were kept."""
        for df in self._kept.values():
            df.unpersist()
        self._kept.clear()

    def place(self, ending: str) -> str | None:
        return next((v for k, v in self.places.items() if k.endswith(ending)), None)

    def gazetteer(self) -> DataFrame:
        path = self.place("language-table")
        if not path:
            raise ValueError("the configuration names no language-table")
        return resources.read_gazetteer(self.spark, path)

    def common(self) -> DataFrame:
        path = self.place("most-common-codes")
        return resources.read_gazetteer(self.spark, path) if path else self.spark.createDataFrame([], "name string, code string")

    def english(self) -> DataFrame:
        path = self.place("english-word-names")
        return resources.read_words(self.spark, path) if path else self.spark.createDataFrame([], "word string")

    def models(self) -> DataFrame | None:
        """(source, kind, name, code, n, gram): Parquet (``models``), and the files of either source that are named.

        A key ``x-directory-index`` (CSV: name, code, folder) makes ``x-language-model`` a folder of models from the
        web; any other ``*-language-model`` is a folder of models built from examples.
        """
        found, columns, end = [], ["source", "kind", "name", "code", "n", "gram"], "-language-model"
        if path := self.place("models"):
            found.append(self.spark.read.parquet(path).select(columns))
        for key, path in self.places.items():
            if key.endswith(end):
                index = self.places.get(key.removesuffix(end) + "-directory-index")
                own = resources.read_web_models(self.spark, path, index) if index else resources.read_field_models(self.spark, path, self.gazetteer())
                found.append(own.select(columns))
        return reduce(DataFrame.unionByName, found) if found else None

    def lines(self, files: list[str]) -> DataFrame:
        if not files:
            raise ValueError("no input files")
        return annotated.read_lines(self.spark, files)

    def mentions(self, files: list[str]) -> DataFrame:
        """Found once for the same files and kept (spilling to disk) until ``close``: features, recall and lists all read them."""
        key = tuple(files)
        if key not in self._kept:
            self._kept[key] = mentions(self.lines(files), self.gazetteer(), self.s.single_mention, self.s.case_sensitive).persist()
        return self._kept[key]

    def counts(self, files: list[str]) -> DataFrame:
        return count_mentions(self.mentions(files), self.gazetteer()).orderBy(F.desc("n"), "name")

    def language_lines(self, files: list[str]) -> DataFrame:
        return sessionize(self.lines(files)).where(has_tag(F.col("tag"), "L", self.s.strict_tags))

    def common_codes(self, files: list[str]) -> DataFrame:
        return evaluate.common_codes(self.language_lines(files), self.gazetteer())

    def instances(self, files: list[str]) -> DataFrame:
        return instances(self.lines(files), self.gazetteer(), self.common(), self.english(), self.models(), self.s, self.mentions(files))

    def truth(self, files: list[str]) -> DataFrame:
        return gold(self.language_lines(files), self.s)

    def train(self, files: list[str], model_path: str, vector_path: str | None = None) -> learn.Model:
        rows = self.instances(files).persist()
        if vector_path:
            vectors(rows).write.mode("overwrite").option("sep", "\t").csv(vector_path)  # document, line of the vector
        model = learn.train(rows)
        rows.unpersist()
        learn.save(model, self.spark, model_path)
        return model

    def predictions(self, rows: DataFrame, model: learn.Model) -> DataFrame:
        return scoring.best(learn.predict(rows, model), LINE)

    def classify(self, files: list[str], model_path: str, out: str) -> None:
        """Annotates each line of a span from its language line on; a span without a candidate stays as it is."""
        model = learn.load(self.spark, model_path)
        best = self.predictions(self.instances(files), model).select("doc_id", "span_ord", "lineno", F.initcap("name").alias("new_name"), F.col("code").alias("new_code"))
        lines = self.lines(files)
        spans = sessionize(lines).select("doc_id", "span_ord", "lineno")
        said = scoring.carry_forward(spans, best, ["doc_id", "span_ord"], values=("new_name", "new_code")).drop("span_ord")
        met = lines.join(said, ["doc_id", "lineno"], "left")
        head = F.when(F.col("new_name").isNotNull(), annotated.with_language(F.col("head"), F.col("new_name"), F.col("new_code"))).otherwise(F.col("head"))
        annotated.write_documents(met.withColumn("head", head), out)

    def test(self, files: list[str], model_path: str, rows: DataFrame | None = None) -> dict[str, DataFrame]:
        rows = self.instances(files) if rows is None else rows
        c = evaluate.compared(self.truth(files), self.predictions(rows, learn.load(self.spark, model_path)), LINE)
        return {"accuracy": evaluate.accuracy(c), "by_file": evaluate.accuracy(c, ["doc_id"]), "by_language": evaluate.per_language(c), "mistakes": evaluate.confusion(c)}

    def recall(self, files: list[str]) -> DataFrame:
        return evaluate.mention_recall(self.truth(files), self.mentions(files))

    def validate(self, files: list[str], folds: int = 5, seed: int = 1) -> tuple[DataFrame, DataFrame]:
        """Results of each fold, and their means and deviations. A document's fold is a hash of its id and the seed."""
        fold = (F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(folds)) + 1).cast("int")
        rows = self.instances(files).withColumn("fold", fold).persist()
        truth = self.truth(files).withColumn("fold", fold).persist()
        found = self.mentions(files)
        out = []
        for k in sorted(r.fold for r in truth.select("fold").distinct().collect()):  # at most ``folds``
            training = rows.where(F.col("fold") != k)
            if training.isEmpty():
                raise ValueError(f"fold {k} leaves nothing to train on")
            best = self.predictions(rows.where(F.col("fold") == k), learn.train(training))
            own = truth.where(F.col("fold") == k)
            a, r = evaluate.accuracy(evaluate.compared(own, best, LINE)).first(), evaluate.mention_recall(own, found).first()
            out.append((k, a.samples, a.acc_name, a.acc_both, a.acc_code, float(r.recall)))
        rows.unpersist()
        truth.unpersist()
        result = self.spark.createDataFrame(out, "fold int, samples long, acc_name double, acc_both double, acc_code double, recall double")
        return result, evaluate.fold_summary(result)

    def build_models(self, collection: str, tier_type: str, out: str) -> None:
        built = models.build_models(resources.read_example_collection(self.spark, collection, tier_type))
        resources.write_models(built.withColumn("source", F.lit("field")), out)
