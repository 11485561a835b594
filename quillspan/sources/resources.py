"""Resource tables: names and codes, word lists, n-gram models and example collections in XML."""

from __future__ import annotations

import csv
import io
import os
import urllib.request
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_name, words


def gazetteer_from(rows: DataFrame) -> DataFrame:
    """``(name, code)`` from ``(name, codes)``: names normalized, one row for each distinct code."""
    return rows.select(normalize_name(F.col("name")).alias("name"), F.explode(words(F.col("codes"))).alias("code")).where("name <> ''").distinct()


def read_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """A language table, or a table of common codes: name, tab, codes between blanks."""
    parts = F.split("value", "\t", 2)
    return gazetteer_from(spark.read.text(path).where(F.col("value").contains("\t")).select(parts[0].alias("name"), parts[1].alias("codes")))


def codes_per_name(gazetteer: DataFrame) -> DataFrame:
    return gazetteer.groupBy("name").agg(F.sort_array(F.collect_set("code")).alias("codes"))


def write_gazetteer(gazetteer: DataFrame, path: str) -> None:
    codes_per_name(gazetteer).select("name", F.array_join("codes", " ").alias("codes")).write.mode("overwrite").option("sep", "\t").csv(path)


def read_words(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where("value <> ''").select(F.col("value").alias("word")).distinct()


_SUFFIX = {"-chartrigrams.txt": ("character", 3), "-words.txt": ("word", 1), "-wordbigrams.txt": ("word", 2)}


def read_field_models(spark: SparkSession, path: str, names: DataFrame) -> DataFrame:
    """Models built from examples: files ``{code}_{name}.char|.word|.morph`` or ``{code}.*``, a gram, a tab, a count.

    ``(source, kind, name, code, n, gram)``; ``name`` is null in models of a code alone. Grams of words and morphemes
    hold their units with a blank between. Names in files have - for /; they are matched with ``names`` (name, code).
    """
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+)\.(char|word|morph)$", 1)
    kind = F.regexp_extract(F.input_file_name(), r"\.(char|word|morph)$", 1)
    rows = spark.read.text(path).select(F.url_decode(stem).alias("stem"), kind.alias("k"), F.split("value", "\t", 2).alias("p")).where("size(p) = 2")
    kinds = F.create_map(*[F.lit(x) for x in ("char", "character", "word", "word", "morph", "morpheme")])
    rows = rows.select(F.split("stem", "_", 2).alias("s"), kinds[F.col("k")].alias("kind"), F.col("p")[0].alias("gram")).select(
        F.col("s")[0].alias("code"), F.try_element_at("s", F.lit(2)).alias("file_name"), "kind", "gram")
    n = F.when(F.col("kind") == "character", F.length("gram")).otherwise(F.size(F.split("gram", " ")))
    known = names.select(F.col("code").alias("c"), F.col("name"), F.replace(F.replace("name", F.lit("/"), F.lit("-")), F.lit(" "), F.lit("_")).alias("f"))
    met = (F.col("code") == F.col("c")) & (F.replace("file_name", F.lit(" "), F.lit("_")) == F.col("f"))
    return rows.join(known, met, "left").select(F.lit("field").alias("source"), "kind", "name", "code", n.alias("n"), "gram", "file_name").where("file_name is null or name is not null").drop("file_name")


def read_web_models(spark: SparkSession, path: str, index_path: str) -> DataFrame:
    """Models from the web: an index (name, iso code, folder) and files of grams and counts between blanks.

    Lines with fewer than two fields are skipped. Padding marks of the files are kept as they stand.
    """
    index = spark.read.option("header", True).csv(index_path).toDF("name", "code", "folder").select(normalize_name(F.col("name")).alias("name"), "code", "folder")
    file = F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]*$", 1)
    suffix = F.regexp_extract(F.input_file_name(), r"(-[a-z]+\.txt)$", 1)
    kinds = F.create_map(*[F.lit(x) for k, v in _SUFFIX.items() for x in (k, v[0])])
    sizes = F.create_map(*[F.lit(x) for k, v in _SUFFIX.items() for x in (k, v[1])])
    rows = spark.read.text(path, recursiveFileLookup=True).select(F.url_decode(file).alias("folder"), suffix.alias("s"), words(F.col("value")).alias("w")).where("size(w) >= 2")
    rows = rows.select("folder", F.try_element_at(kinds, F.col("s")).alias("kind"), F.try_element_at(sizes, F.col("s")).alias("n"), F.array_join(F.expr("slice(w, 1, size(w) - 1)"), " ").alias("gram"))
    return rows.where("kind is not null").join(index, "folder").select(F.lit("web").alias("source"), "kind", "name", "code", "n", "gram")


def write_models(models: DataFrame, path: str) -> None:
    """Partitioned by source and kind, sorted by code: a query for some codes reads few row groups."""
    models.repartition("source", "kind", "code").sortWithinPartitions("code", "name", "n").write.mode("overwrite").partitionBy("source", "kind").parquet(path)


def read_example_collection(spark: SparkSession, path: str, tier_type: str, state: str = "normalized") -> DataFrame:
    """``(code, name, text)`` of language lines of an XML collection of examples.

    Read from each ``igt`` element whose subject has the code of the file's name (its last three letters): items of
    the tiers of this type and state whose tag is L, alone or with CR, AL, DB or SEG.
    """
    rows = spark.read.format("xml").option("rowTag", "igt").option("attributePrefix", "_").option("valueTag", "_VALUE").schema(
        "metadata STRUCT<meta: ARRAY<STRUCT<subject: ARRAY<STRUCT<_VALUE: STRING, `_olac:code`: STRING>>>>>,"
        "tier ARRAY<STRUCT<_type: STRING, _state: STRING, item: ARRAY<STRUCT<_VALUE: STRING, _tag: STRING>>>>").load(path)
    own = F.regexp_extract(F.input_file_name(), r"(.{3})\.xml$", 1)
    rows = rows.select(own.alias("code"), F.flatten(F.transform("metadata.meta", lambda m: F.coalesce(m["subject"], F.array()))).alias("subjects"), "tier")
    rows = rows.withColumn("subject", F.filter("subjects", lambda s: s.getField("_olac:code") == F.col("code"))).where("size(subject) > 0")
    items = F.flatten(F.transform(F.filter("tier", lambda t: (t["_type"] == tier_type) & (t["_state"] == state)), lambda t: F.coalesce(t["item"], F.array())))
    rows = rows.select("code", F.lower(F.col("subject")[0]["_VALUE"]).alias("name"), F.explode(items).alias("item"))
    return rows.where(F.col("item._tag").rlike(r"^L(?:\+(?:CR|AL|DB|SEG))*$")).select("code", "name", F.col("item._VALUE").alias("text"))


def download_web_models(index_csv: str, base: str, to: str, seconds: float = 10.0, fetch=urllib.request.urlopen) -> list[tuple[str, str]]:
    """Fetch and unpack the archive of each code in an index; driver-side. Returns (code, outcome).

    Archives that are there already are kept; a timeout or any answer but 200 skips the code.
    """
    out = []
    with open(index_csv, encoding="utf-8", newline="") as f:
        for row in list(csv.reader(f))[1:]:
            code, iso = row[0], row[8]
            folder = os.path.join(to, f"{iso}_{code}")
            if os.path.isdir(folder):
                out.append((code, "kept"))
                continue
            try:
                with fetch(f"{base.rstrip('/')}/{code}.zip", timeout=seconds) as r:
                    if r.status != 200:
                        out.append((code, f"skipped: {r.status}"))
                        continue
                    data = r.read()
            except OSError as e:
                out.append((code, f"skipped: {e}"))
                continue
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                z.extractall(folder)
            out.append((code, "fetched"))
    return out
