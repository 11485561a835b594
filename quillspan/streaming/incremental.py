"""New documents as they arrive: a file stream whose micro-batches run the batch plans unchanged.

Every operator works within a document and a file holds whole documents, so the stream needs no state and no
watermark; a micro-batch is a DataFrame of whole files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.mentions import mentions
from ..sources.annotated import parse_files


def watch(spark: SparkSession, path: str, checkpoint: str, each: Callable[[DataFrame, int], None], once: bool = True, files: int = 1000) -> StreamingQuery:
    """Calls ``each(lines, batch_id)`` with the lines of the files that are new in a folder.

    ``checkpoint`` keeps what has been read, so a restart goes on where the stream was lost. ``once`` ends after the
    files that are there.
    """
    stream = spark.readStream.format("text").schema("value string").option("wholetext", True).option("maxFilesPerTrigger", files).load(path)
    named = stream.select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("file"), "value")
    writer = named.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, i: each(parse_files(df), i))
    return (writer.trigger(availableNow=True) if once else writer).start()


def watch_mentions(spark: SparkSession, path: str, checkpoint: str, gazetteer: DataFrame, out: str, **options) -> StreamingQuery:
    """Mentions of arriving documents, appended as Parquet by batch: a batch that is run again replaces itself."""

    def each(lines: DataFrame, i: int) -> None:
        mentions(lines, gazetteer).write.mode("overwrite").parquet(f"{out}/batch={i}")

    return watch(spark, path, checkpoint, each, **options)
