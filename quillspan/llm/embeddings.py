"""Near-duplicate embeddings by a pivot-permutation index.

A vector is described by the ordered list of its nearest reference points (pivots). Vectors at a cosine of 0.95 or
more share pivots of their lists, so candidates are retrieved through inverted lists and pruned by the number of
pivots they share before anything is compared; survivors are verified by their cosine in double precision.

1. Equal vectors are collapsed. Each distinct one is posted, by its number and its list alone, to an inverted list for
   every two of its pivots.
2. Within an inverted list the members are counted by a third shared pivot. A *unit* is three pivots that several
   vectors share; a vector is a member of a unit only if it may meet another there for the first time (a pair is
   counted in the unit of its three lowest shared pivots). The number of pivots grows with the cube root of the number
   of vectors, so that unrelated vectors seldom share three, and the work grows with the input.
3. Vectors are sent to their units and verified there. A large unit is cut into blocks, and every two blocks meet in
   one task. Links become counts for each vector and a spanning forest, never a table of all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import connected_components, materialize
from .simhash import forest

#: Pivots that candidates share at least.
SHARED = 3
#: Pivots at least and at most.
FEWEST, MOST = 256, 1 << 14
#: Members of an inverted list that are counted together, vectors to a block of a unit, and rows of a product at a time.
CHUNK, BLOCK, ROWS = 100_000, 8192, 1024


def index_size(n: int) -> tuple[int, int]:
    """Pivots, and length of a vector's list, for n distinct vectors: unrelated ones share three with a chance of 1 / n."""
    pivots = 1 << max(0, int(np.ceil(np.log2(max(n, 1) * 38_000) / 3)))
    pivots = min(MOST, max(FEWEST, pivots))
    return pivots, 8 if pivots <= 2048 else 12


@lru_cache(maxsize=4)
def pivots(dim: int, n: int) -> np.ndarray:
    """Reference points on the unit sphere, fixed by the dimension: no sample of the data is needed."""
    p = np.random.default_rng(1000 + dim).standard_normal((n, dim))
    return p / np.linalg.norm(p, axis=1, keepdims=True)


def permutations_of(unit: np.ndarray, n: int, listed: int) -> np.ndarray:
    """For each unit vector its nearest of n pivots, nearest first (ties: the lower number)."""
    out = np.empty((len(unit), listed), np.int16)
    p = pivots(unit.shape[1], n).T
    for i in range(0, len(unit), 2048):
        y = -(unit[i : i + 2048] @ p)
        near = np.sort(np.argpartition(y, listed - 1, axis=1)[:, :listed], axis=1)
        # pivots as near as the last one, of which others were picked, do not matter: their numbers decide nothing
        order = np.argsort(np.take_along_axis(y, near, axis=1), axis=1, kind="stable")
        out[i : i + 2048] = np.take_along_axis(near, order, axis=1)
    return out


def _dim(vec: bytes) -> int:
    return (len(vec) - 1) // (4 if vec[:1] == b"f" else 8)


def _unit(data: list[bytes]) -> np.ndarray:
    """Vectors of one length in double precision, scaled to length 1."""
    x = np.stack([np.frombuffer(d, "<f4" if d[:1] == b"f" else "<f8", offset=1) for d in data]).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _classes(rows: DataFrame, vec: str, key: str) -> DataFrame:
    """``(vec_id, vec)``: a vector as bytes, null where it links with nothing.

    ``f`` and little-endian floats where they hold all its components exactly, otherwise ``d`` and doubles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            ends = lists.offsets.to_numpy().astype(np.int64)
            size = np.where(lists.is_valid().to_numpy(zero_copy_only=False), np.diff(ends), 0)
            x = lists.values.to_numpy(zero_copy_only=False).astype("<f8") + 0.0  # a null component is NaN; no negative zeros
            x = np.r_[x, 0.0]
            start = ends[:-1]
            with np.errstate(over="ignore", invalid="ignore"):
                short = x.astype("<f4")
            count = lambda mark: np.r_[0, np.cumsum(mark)][start + size] - np.r_[0, np.cumsum(mark)][start]
            ok = (size > 0) & (count(~np.isfinite(x)) == 0) & (count(x != 0) > 0)
            exact = count(short != x) == 0
            data = [(b"f" + short[i : i + k].tobytes() if f else b"d" + x[i : i + k].tobytes()) if good else None for i, k, good, f in zip(start.tolist(), size.tolist(), ok.tolist(), exact.tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], names=["vec_id", "vec"])

    return rows.select(F.col(key).cast("long").alias("vec_id"), F.col(vec).cast("array<double>").alias("v")).mapInArrow(run, "vec_id long, vec binary")


def _described(nodes: DataFrame, count: int, listed: int) -> DataFrame:
    """``nodes`` with ``top``: the numbers of a vector's pivots in rising order, as 16-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vec = b.column(2).to_pylist()
            top: list[bytes] = [b""] * len(vec)
            sizes = np.array([_dim(v) for v in vec])
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                for i, t in zip(at, np.sort(permutations_of(_unit([vec[i] for i in at]), count, listed), axis=1)):
                    top[i] = t.tobytes()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(top, pa.binary())], names=["rep", "n", "vec", "top"])

    return nodes.select("rep", "n", "vec").mapInArrow(run, "rep long, n long, vec binary, top binary")


def _postings(described: DataFrame, count: int, listed: int) -> DataFrame:
    """``(list, rep, top)``: each vector in the lists of every two of its pivots after which a third can come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            top = np.frombuffer(b"".join(b.column(2).to_pylist()), np.int16).reshape(-1, listed).astype(np.int64)
            dim = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, j in combinations(range(listed - 1), 2):
                yield pa.RecordBatch.from_arrays([pa.array((dim * count + top[:, i]) * count + top[:, j]), b.column(0), b.column(2)], names=["list", "rep", "top"])

    return described.select("rep", F.expr("cast((octet_length(vec) - 1) / IF(substring(vec, 1, 1) = X'66', 4, 8) AS int)").alias("dim"), "top").mapInArrow(run, "list long, rep long, top binary")


def members_of_lists(number: np.ndarray, rep: np.ndarray, top: np.ndarray, count: int, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """``(unit, rep)`` of inverted lists (``number`` sorted): their members by each third pivot that several share.

    A unit in which every two members share a lower pivot too is left out: its pairs are counted in another unit. Of a
    list that is not ``whole`` (a part of a very long one) all members of all units are given.
    """
    if whole:  # lists of one member are done with
        same = np.r_[number[1:] == number[:-1], False]
        met = same | np.r_[False, same[:-1]]
        number, rep, top = number[met], rep[met], top[met]
    row, col = np.nonzero(top > (number % count)[:, None])
    unit = number[row] * count + top[row, col]
    o = np.argsort(unit, kind="stable")
    row, unit = row[o], unit[o]
    if not whole or not len(unit):
        return unit, rep[row]
    start = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
    size = np.diff(np.r_[start, len(unit)])
    keep = np.zeros(len(unit), bool)
    for s, m in zip(start[size > 1].tolist(), size[size > 1].tolist()):
        r, t = top[row[s : s + m]], unit[s] % count
        q, p = unit[s] // count % count, unit[s] // count // count % count
        lower = np.where((r < t) & (r != p) & (r != q), r, -1)  # pivots below the third one, but for the two of the list
        if m == 2:
            keep[s : s + 2] = not np.intersect1d(lower[0][lower[0] >= 0], lower[1]).size
            continue
        sets, of = np.unique(lower, axis=0, return_inverse=True)
        if (sets[0] == -1).all() or len(sets) > 512:
            # some member has no lower pivot, or there are many kinds: all stay, the pairs are sorted out when verified
            keep[s : s + m] = True
            continue
        shared = np.zeros((len(sets), len(sets)), bool)
        for x in np.unique(sets[sets >= 0]):
            has = (sets == x).any(axis=1)
            shared |= has[:, None] & has[None, :]
        keep[s : s + m] = (~shared).any(axis=1)[of.ravel()]
    return unit[keep], rep[row[keep]]


def _memberships(postings: DataFrame, count: int, listed: int, tasks: int) -> DataFrame:
    """``(unit, rep)``"""
    dealt = postings.repartition(tasks, "list").sortWithinPartitions("list")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        partial: int | None = None  # a list of which a part has been given already

        def flush(end: bool) -> Iterator[pa.RecordBatch]:
            """Lists that are complete, and of one that is longer than CHUNK what is there of it."""
            nonlocal held, partial
            key, rep, top = (np.concatenate(x) for x in zip(*held))
            parts = []
            if partial is not None:
                cut = int(np.searchsorted(key, partial, side="right"))
                parts.append((slice(0, cut), False))
            else:
                cut = 0
            last = len(key) if end else max(cut, int(np.searchsorted(key, key[-1])))
            parts.append((slice(cut, last), True))
            if last < len(key) - CHUNK // 2 or partial == key[-1]:  # the last list is very long
                partial = int(key[-1])
                parts.append((slice(last, len(key)), False))
                last = len(key)
            elif cut < len(key):
                partial = None
            held = [[key[last:], rep[last:], top[last:]]] if last < len(key) else []
            for part, whole in parts:
                unit, members = members_of_lists(key[part], rep[part], top[part], count, whole)
                if len(unit):
                    yield pa.RecordBatch.from_arrays([pa.array(unit), pa.array(members)], names=["unit", "rep"])

        for b in batches:
            if b.num_rows:
                top = np.frombuffer(b"".join(b.column(2).to_pylist()), np.int16).reshape(-1, listed)
                held.append([b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), top])
                if sum(len(h[0]) for h in held) >= CHUNK:
                    yield from flush(False)
        if held:
            yield from flush(True)

    return dealt.mapInArrow(run, "unit long, rep long")


def verified(v: np.ndarray, top: np.ndarray, left: np.ndarray, right: np.ndarray, own: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of ``left`` and ``right`` at the threshold or above whose lowest shared pivots are ``own``."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for k in range(0, len(left), ROWS):
        part = left[k : k + ROWS]
        i, j = np.nonzero(v[part] @ v[right].T >= threshold)
        i, j = part[i], right[j]
        for s in range(0, len(i), 1 << 18):
            x, y = i[s : s + (1 << 18)], j[s : s + (1 << 18)]
            hit = (top[x][:, :, None] == top[y][:, None, :]).any(axis=2)
            low = np.sort(np.where(hit, top[x], np.iinfo(np.int16).max), axis=1)[:, :SHARED]
            ok = (low == own).all(axis=1)
            found.append((x[ok], y[ok]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def embedding_components(rows: DataFrame, threshold: float = 0.95, vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for each row of ``rows``.

    ``n_links`` counts the other rows found at a cosine of ``threshold`` or above, copies included; ``component_id``
    is the smallest vec_id reachable by links, itself included; ``kept`` tells whether that is the row's own. Vectors
    that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of different
    lengths do not link. Rows that share a vec_id count as one for components; rows with a null id are counted and
    labelled, and never a component's smallest. Labels and other columns are not read; empty in, empty out.
    """
    spark = rows.sparkSession
    own = materialize(_classes(rows, vec, key).withColumn("class", F.unhex(F.md5("vec"))), "vectors")
    nodes = materialize(own.where("vec is not null").groupBy("class").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("vec").alias("vec")), "classes")
    classes = nodes.count()
    count, listed = index_size(classes)
    # classes whose rows all lack an id are told apart by a negative number of their own
    nodes = nodes.withColumn("node", F.coalesce("rep", -F.abs(F.xxhash64("class")) - 2))
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    described = materialize(_described(nodes.select(F.col("node").alias("rep"), "n", "vec"), count, listed), "described")
    members = materialize(_memberships(_postings(described, count, listed), count, listed, max(shuffles, classes * listed // 200_000)), "members")
    sizes = members.groupBy("unit").agg(F.count("*").alias("m")).where(f"m > {BLOCK}").select("unit", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    units = members.join(sizes, "unit", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    units = units.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select("unit", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "rep")
    filled = units.join(described, "rep").select("unit", "x", "y", "block", "rep", "n", "vec", "top")
    dealt = filled.repartition(max(shuffles, classes // 50_000), "unit", "x", "y").sortWithinPartitions("unit", "x", "y", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at: tuple | None = None
        for b in batches:
            keys = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(3)], axis=1).astype(np.int64)
            cuts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]) if len(keys) else []
            for s, e in zip(cuts, [*cuts[1:], len(keys)]):
                if tuple(keys[s]) != at:
                    yield from unit(at, held)
                    at, held = tuple(keys[s]), []
                held.append(b.slice(s, e - s))
        yield from unit(at, held)

    def unit(at: tuple | None, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if sum(h.num_rows for h in held) < 2:
            return
        number, x, y = at
        own_pivots = np.array([number // count**i % count for i in reversed(range(SHARED))])
        blocks, rep, n = (np.concatenate([h.column(i).to_numpy(zero_copy_only=False) for h in held]) for i in (3, 4, 5))
        v = _unit([d for h in held for d in h.column(6).to_pylist()])
        top = np.frombuffer(b"".join([d for h in held for d in h.column(7).to_pylist()]), np.int16).reshape(len(v), -1)
        left = np.flatnonzero(blocks == x)
        right = left if x == y else np.flatnonzero(blocks == y)
        i, j = verified(v, top, left, right, own_pivots, threshold)
        if x == y:
            i, j = i[i < j], j[i < j]
        if len(i):
            linked = np.bincount(i, n[j], len(v)) + np.bincount(j, n[i], len(v))
            o = np.argsort(rep, kind="stable")
            rank = np.argsort(o, kind="stable")
            low = o[forest(rank[i], rank[j], len(v))][rank]
            some = np.flatnonzero(linked)
            yield pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(linked[some].astype(np.int64)), pa.array(rep[low[some]])], names=["rep", "m", "low"])

    found = materialize(dealt.mapInArrow(run, "rep long, m long, low long"), "links")
    cc = connected_components(found.select(F.col("rep").alias("a"), F.col("low").alias("b")))
    counts = found.groupBy("rep").agg(F.sum("m").alias("m")).withColumnRenamed("rep", "node")
    label = nodes.select("class", "rep", "n", "node").join(counts, "node", "left").join(cc, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # a component is named by its smallest id; those without any stay unnamed
    first = label.groupBy("component").agg(F.min("rep").alias("component_id"))
    label = label.join(first, "component").select("class", (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("n_links"), "component_id")
    out = own.select("vec_id", "class").join(label, "class", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
