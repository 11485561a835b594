"""Near copies by edit embedding: banded samples find candidates, likeness of the whole fingerprints verifies them.

Two texts meet if they have the same bytes at the sampled positions of one of the bands. A pair that meets is linked
if its fingerprints (``editprint``) agree in enough samples; components of the links are the groups of near copies.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .editprint import SLOTS, walk
from .shared import connected_components, materialize
from .simhash import MISSED, link_wide
from .words import slices

#: Share of samples in which unrelated texts may agree, for the size of buckets.
UNRELATED = 0.25


def bands(n: int, least: float) -> np.ndarray:
    """Sampled positions, a row for each band: buckets of some 32 of n unrelated texts, and MISSED of the pairs at ``least`` unmet."""
    k = max(4, math.ceil(math.log(max(n, 32) / 32) / -math.log(UNRELATED)))
    return np.random.default_rng(23).integers(0, SLOTS, (math.ceil(math.log(1 / MISSED) / least**k), k))


def near_copy_components(docs: DataFrame, least: float = 0.8, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(doc_id, component_id)`` for every row: the smallest doc_id reachable by links of likeness ``least`` or above.

    Null texts count as empty, and empty texts are alike. Rows without an id are labelled but link nothing that has no
    row with an id (component_id null). Equal fingerprints are collapsed first, and a bucket returns a spanning
    forest, so a group of copies costs its size. Other columns are not read; an empty table gives an empty result.
    """

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            fp = [x.tobytes() for x in walk(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.binary())], names=["doc_id", "fp"])

    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    own = materialize(source.mapInArrow(prints, "doc_id long, fp binary"), "fingerprints")
    nodes = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    n = nodes.count()
    chosen, most = bands(n, least), math.floor((1 - least) * SLOTS + 1e-9)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(-1, SLOTS)
            for t, at in enumerate(chosen):
                key = np.array([xxhash.xxh64_intdigest(x.tobytes(), t) for x in fp[:, at]], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), b.column(0), b.column(1)], names=["key", "fp", "rep"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes, int]] = []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if held and held[-1][0] != row[0]:
                    yield from linked(held)
                    held = []
                held.append(row)
        yield from linked(held)

    def linked(held: list[tuple[int, bytes, int]]) -> Iterator[pa.RecordBatch]:
        if len(held) < 2:
            return
        rep = np.array([x[2] for x in held], dtype=np.int64)
        fp = np.frombuffer(b"".join([x[1] for x in held]), np.uint8).reshape(len(held), -1)
        low = link_wide(fp, most, lambda a, b: (a != b).sum(axis=-1, dtype=np.int32))
        at = np.flatnonzero(low != np.arange(len(low)))
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(rep[at]), pa.array(rep[low[at]])], names=["a", "b"])

    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n * len(chosen) // 500_000))
    dealt = nodes.where("rep is not null").mapInArrow(keys, "key long, fp binary, rep long").repartition(tasks, "key").sortWithinPartitions("key")
    cc = connected_components(dealt.mapInArrow(run, "a long, b long"))
    label = nodes.join(cc, nodes.rep == cc.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return own.join(label, "fp").select("doc_id", "component_id")
