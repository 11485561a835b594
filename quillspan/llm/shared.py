"""What several corpus operators need: tables in the shared folder and connected components.

Cluster rules kept here: lineage is cut by writing Parquet under ``spark.checkpoint.dir`` (a folder that the
driver and all executors share), so a lost executor costs a re-read and never a lost block. Nothing is put
into a machine-local folder unless the session names no shared folder and is a local one, as in tests.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: (session, path, scope)
_WRITTEN: list[tuple[SparkSession, str, str]] = []
_SCOPE: list[str] = []
_OWN_DIR: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where the session names none and runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="quillspan-"))
    return "file://" + _OWN_DIR[0]


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores before those that a column has already (whatever its case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


#: Rows of whole texts that go to a Python worker at once, where the session has no number of its own.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Whole texts can be long: the usual 10,000 rows of them in one Arrow batch would be no bounded memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: plans after it start from files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillspan/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path, compression="zstd")
    _WRITTEN.append((spark, path, _SCOPE[-1] if _SCOPE else ""))
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scope(name: str) -> Iterator[None]:
    """Tables written inside belong to ``name``, and ``release(spark, name)`` deletes them."""
    _SCOPE.append(name)
    try:
        yield
    finally:
        _SCOPE.pop()


def release(spark: SparkSession, name: str, keep: int = 0) -> None:
    """Delete the tables written in a scope, but for the last ``keep``. No DataFrame that reads them may be in use."""
    own = [x for x in _WRITTEN if x[0] is spark and x[2] == name]
    for x in own[: max(0, len(own) - keep)]:
        _WRITTEN.remove(x)
        path = spark._jvm.org.apache.hadoop.fs.Path(x[1])
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path.getParent(), True)


_CALLS: dict[str, int] = {}


@contextlib.contextmanager
def call_scope(spark: SparkSession, name: str) -> Iterator[None]:
    """For a query: what it writes is deleted when the query is called for the second time after this call."""
    k = _CALLS[name] = _CALLS.get(name, 0) + 1
    release(spark, f"{name}#{k - 2}")
    with scope(f"{name}#{k}"):
        yield


@atexit.register
def _drop_own() -> None:
    import shutil

    for d in _OWN_DIR:
        shutil.rmtree(d, ignore_errors=True)


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Components of an undirected graph given as ``(a long, b long)``; returns ``(node, component)``.

    Alternating large-star and small-star steps (Kiveris et al., 2014), written as a partial-aggregated ``min``
    and a join, so a hub's neighbours never meet in one task: the aggregate keeps one number for each node and
    the join is one that AQE can split. ``component`` is the smallest node of the component. Nodes without an
    edge do not appear. Edges with a null end and loops are ignored; an empty input gives an empty result.
    """
    e = materialize(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(max_rounds):
        ends = e.select(F.col("a").alias("n"), F.lit(1).alias("left"), F.lit(0).alias("right")).unionByName(
            e.select(F.col("b").alias("n"), F.lit(0).alias("left"), F.lit(1).alias("right")))
        tangled = ends.groupBy("n").agg(F.sum("left").alias("l"), F.max("right").alias("r")).where("l > 1 or (l = 1 and r = 1)")
        if tangled.isEmpty():  # every node points at the smallest of its component
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("m", "a").alias("m"))
        large = both.join(low, both.a == low.k).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
        met = large.join(low, large.a == low.k)
        small = met.select(F.col("a"), F.col("m").alias("b")).unionByName(met.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        e = materialize(small.distinct(), "edges")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
