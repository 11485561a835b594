"""Line-oriented, attribute-annotated documents as a table of lines, and back.

A block is a header (``doc_id= page= block_id= bbox= label= first last``) and its lines; a line is a list of
``key=value`` attributes, a colon, and the content, whose leading blanks count.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HEAD = r"^(line=\d+\s.*?bbox=[\d.,\-]+(?:\s+iscore=[\d.]+)?\s*):(.*)$"
ATTRIBUTE = r"(\w+)=(.*?)(?=\s+\w+=|\s*$)"


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """A row for each line of each file, with its block.

    Columns: ``file, doc_id, page, block_id, block_ord, label, block_head, lineno, tag, span_id, lang_name,
    lang_code, attrs, head, text``. Files are read whole, one row each; blocks and lines are exploded without a
    shuffle. What is neither a header nor a line is left out; an attribute that is missing is null.
    """
    return parse_files(spark.read.text(paths, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("file"), "value"))


def parse_files(files: DataFrame) -> DataFrame:
    """The same from ``(file, value)``, a row for each whole file."""
    files = files.select("file", F.regexp_replace("value", "\r\n", "\n").alias("value"))
    blocks = files.select("file", F.posexplode(F.split("value", r"\n[ \t]*\n")).alias("block_ord", "block")).withColumn("rows", F.split(F.ltrim("block", F.lit("\n")), "\n"))
    head = F.col("rows")[0]
    part = lambda key: F.regexp_extract("block_head", rf"(?:^|\s){key}=(\S*)", 1)
    lines = blocks.where(head.startswith("doc_id=")).select("file", "block_ord", head.alias("block_head"), F.explode("rows").alias("row")).where(F.col("row").rlike(HEAD))
    lines = lines.select("file", part("doc_id").alias("doc_id"), part("page").cast("int").alias("page"), part("block_id").alias("block_id"), "block_ord", part("label").alias("label"), "block_head",
                         F.regexp_extract("row", HEAD, 1).alias("head"), F.regexp_extract("row", HEAD, 2).alias("text"))
    attrs = F.map_from_arrays(F.regexp_extract_all("head", F.lit(ATTRIBUTE), F.lit(1)), F.regexp_extract_all("head", F.lit(ATTRIBUTE), F.lit(2)))
    lines = lines.withColumn("attrs", attrs)
    own = lambda key: F.try_element_at("attrs", F.lit(key)).alias(key)
    return lines.select("file", "doc_id", "page", "block_id", "block_ord", "label", "block_head", F.try_element_at("attrs", F.lit("line")).cast("int").alias("lineno"),
                        own("tag"), own("span_id"), own("lang_name"), own("lang_code"), "attrs", "head", "text")


def with_language(head, name, code):
    """The head with these language attributes, put after the span id if it had none."""
    bare = F.regexp_replace(head, r"\s+lang_(?:name|code)=.*?(?=\s+\w+=|\s*$)", "")
    return F.regexp_replace(bare, r"(span_id=\S+)", F.concat(F.lit("$1 lang_code="), code, F.lit(" lang_name="), name))


def render(lines: DataFrame) -> DataFrame:
    """``(file, value)``: the whole text of each document; a document is one row, as it was when read."""
    w = Window.partitionBy("file", "block_ord")
    rows = lines.withColumn("first", F.min("lineno").over(w))
    line = F.concat("head", F.lit(":"), "text")
    value = F.when(F.col("lineno") == F.col("first"), F.concat("block_head", F.lit("\n"), line)).otherwise(line)
    last = F.max("lineno").over(w)
    rows = rows.withColumn("value", F.when(F.col("lineno") == last, F.concat(value, F.lit("\n"))).otherwise(value))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("lineno", "value"))), lambda x: x["value"]), "\n")
    return rows.groupBy("file").agg(body.alias("value"))


#: Buckets of files into which documents are written.
BUCKETS = 64


def write_documents(lines: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Parquet ``(file, value)``: the whole text of each document beside its name, in a bounded number of files."""
    render(lines).repartition(buckets, "file").write.mode("overwrite").parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Lines of what ``write_documents`` has written."""
    return parse_files(spark.read.parquet(path).select("file", "value"))


def export_documents(spark: SparkSession, path: str, to: str) -> int:
    """Plain files under a local folder from what ``write_documents`` has written, one at a time; returns how many."""
    os.makedirs(to, exist_ok=True)
    n = 0
    for r in spark.read.parquet(path).toLocalIterator():
        with open(os.path.join(to, os.path.basename(r.file)), "w", encoding="utf-8", newline="") as f:
            f.write(r.value)
        n += 1
    return n
