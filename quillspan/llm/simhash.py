"""SimHash near-duplicates by pivot distance tables.

Every whole text becomes one 64-bit fingerprint. Distances to many reference fingerprints are computed once for
each distinct fingerprint. The references are a base and its variants on disjoint masks, so that the coordinate
``d(x, base) - d(x, variant)`` tells how many bits of the mask differ: two fingerprints within the radius have
coordinates that differ by at most the radius, and (pigeonhole) agree exactly on all masks of most groups of
masks. Pairs therefore meet by equal coordinates of some groups, are discarded by their largest coordinate
difference over the whole table, and survivors are verified by their true distance. No link is lost.

Equal fingerprints are collapsed first (one row with the smallest id, by partial aggregation), so a group of
copies costs one row in the search, whatever its size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .editprint import _mix
from .shared import connected_components, materialize
from .words import slices

#: Disjoint masks of two bits, dealt out by a fixed permutation, and how many of them each group holds.
_BITS = np.random.default_rng(7).permutation(64).reshape(32, 2)
MASKS = [(1 << int(a)) | (1 << int(b)) for a, b in _BITS]
BASE = 0x9E3779B97F4A7C15
SMALL_RUN = 48


def words_of(data: bytes | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return (data or b"").lower().split()


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``size`` words joined by spaces; of all words if there are fewer."""
    if not words:
        return np.zeros(0, np.uint64)
    grams = list(map(b" ".join, zip(*(words[i:] for i in range(size))))) if len(words) > size else [b" ".join(words)]
    return np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42)), dtype=np.uint64, count=len(grams))


def simhash(data: bytes | None, size: int = 3) -> int:
    """The fingerprint: a bit is 1 if it is set in over half of the hashes; 0 if there are no words."""
    h = shingle_hashes(words_of(data), size)
    if not len(h):
        return 0
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 15):
        part = h[i : i + (1 << 15)]
        bits = np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).astype(np.float32)
        counts += (bits.T @ np.ones(len(part), np.float32)).astype(np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, size: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(doc_id, fp long)``; only the two columns are read. A null or blank text has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            fp = np.array([simhash(x.as_py(), size) for x in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("t")).mapInArrow(run, "doc_id long, fp long")


def group_keys(fp: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint a key for each choice of mask groups that a pair within the radius may leave untouched.

    A mask's coordinate (bits of it in which the fingerprint differs from the base: 0, 1 or 2) comes from the
    distances to the base and to its variant on that mask; a key is the number of the choice and the coordinates
    of all masks of the chosen groups.
    """
    n, t = radius + 3, _table(fp).astype(np.int64)
    coordinate = (t[:, :1] - t[:, 1:]) // 2 + 1
    part = []
    for i in range(n):
        key = np.zeros(len(fp), np.int64)
        for c in coordinate[:, i::n].T:
            key = key * 3 + c
        part.append(key)
    keys, choices = [], list(combinations(range(n), n - radius))
    for number, chosen in enumerate(choices):
        key = np.zeros(len(fp), np.int64)
        for i in chosen:
            key = key * 3 ** len(MASKS[i::n]) + part[i]
        keys.append(key * len(choices) + number)
    return np.stack(keys, axis=1)


def _table(x: np.ndarray) -> np.ndarray:
    """Distances of fingerprints to all references."""
    refs = np.array([BASE] + [BASE ^ m for m in MASKS], dtype=np.uint64)
    return np.bitwise_count(x[:, None] ^ refs[None, :]).astype(np.int8)


def links_in_runs(key: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that are linked within runs of equal ``key`` (sorted by key, then fp).

    Short runs compare every two of their members by the table. A long run looks up each member's possible
    neighbours in the sorted run, which grows with the run and not with its square.
    """
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    left, right = [], []
    run = np.repeat(np.arange(len(starts)), sizes)
    short = np.flatnonzero(sizes[run] <= SMALL_RUN)
    if len(short):
        r, x = run[short], fp[short]
        t = _table(x)
        for d in range(1, int(sizes[sizes <= SMALL_RUN].max())):
            i = np.flatnonzero(r[d:] == r[:-d])
            i = i[np.abs(t[i] - t[i + d]).max(axis=1) <= radius]  # discard by the largest coordinate difference
            i = i[np.bitwise_count(x[i] ^ x[i + d]) <= radius]
            left.append(short[i])
            right.append(short[i + d])
    flips = [sum(1 << b for b in c) for k in range(1, radius + 1) for c in combinations(range(64), k)]
    for s, n in zip(starts[sizes > SMALL_RUN], sizes[sizes > SMALL_RUN]):
        x = fp[s : s + n]
        for m in flips:
            y = x ^ np.uint64(m)
            at = np.minimum(np.searchsorted(x, y), n - 1)
            i = np.flatnonzero((x[at] == y) & (x < y))
            if len(i):
                left.append(s + i)
                right.append(s + at[i])
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` nodes the smallest node reachable by the pairs (a, b)."""
    low = np.arange(n)
    if not len(a):
        return low
    while True:
        m = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, a, m)
        np.minimum.at(new, b, m)
        new = new[new]
        if (new == low).all():
            return low
        low = new


def fingerprint_links(nodes: DataFrame, radius: int = 2) -> DataFrame:
    """Edges ``(a, b)`` between representatives whose fingerprints differ in at most ``radius`` bits.

    ``nodes`` has one row ``(fp, rep)`` for each distinct fingerprint. Within a bucket only a spanning forest is
    returned, not all pairs; the components are those of all links. Rows are dealt by bucket key and streamed
    in key order, so a task holds one run of distinct fingerprints at a time.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, rep = (b.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            k = group_keys(fp.view(np.uint64), radius)
            each = k.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(k.ravel()), pa.array(np.repeat(fp, each)), pa.array(np.repeat(rep, each))], names=["key", "fp", "rep"])

    keyed = nodes.where("rep is not null").select("fp", "rep").mapInArrow(keys, "key long, fp long, rep long")
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartition(n, "key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            now = [b.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            if not len(held[0]) or held[0][0] == held[0][-1]:
                continue
            cut = np.searchsorted(held[0], held[0][-1])
            yield from linked(*(x[:cut] for x in held))
            held = [x[cut:] for x in held]
        if held is not None:
            yield from linked(*held)

    def linked(key: np.ndarray, fp: np.ndarray, rep: np.ndarray) -> Iterator[pa.RecordBatch]:
        same = np.r_[key[1:] == key[:-1], False]
        met = same | np.r_[False, same[:-1]]  # alone in its bucket: nothing to do
        key, fp, rep = key[met], fp[met].view(np.uint64), rep[met]
        o = np.lexsort((fp, key))
        key, fp, rep = key[o], fp[o], rep[o]
        if len(key):
            low = forest(*links_in_runs(key, fp, radius), len(key))
            at = np.flatnonzero(low != np.arange(len(low)))
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(rep[at]), pa.array(rep[low[at]])], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def simhash_components(docs: DataFrame, size: int = 3, radius: int = 2, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs``.

    ``fingerprint`` is 16 lower-case hex digits; ``component_id`` is the smallest doc_id reachable by links of at
    most ``radius`` differing bits, itself included; rows that share a doc_id count as one document. Null, empty and blank texts have fingerprint zero and are
    linked like any other; repeated rows are kept; a row with a null doc_id is labelled but is never the smallest,
    and a fingerprint borne only by such rows links nothing (component_id null). Other columns are not read. An
    empty table gives an empty result.
    """
    own = materialize(fingerprints(docs, size, text, key), "fingerprints")
    nodes = own.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    cc = connected_components(fingerprint_links(nodes, radius))
    label = nodes.join(cc, nodes.rep == cc.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return own.join(label, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Lanes of 64 bits of a wide fingerprint, and the share of pairs at the wanted similarity that keys may miss.
LANES, MISSED = 8, 0.02
#: Fingerprints of a bucket above which it is hot, and of how many fingerprints one is counted to tell (balance only).
HOT, COUNTED = 4096, 16


def wide_fingerprint(h: np.ndarray) -> bytes:
    """512 bits over the distinct shingles: each bit is 1 if it is set in over half of them. Zeros without words."""
    counts = np.zeros(64 * LANES, np.int64)
    for i in range(0, len(h), 1 << 12):
        part = h[i : i + (1 << 12)]
        lanes = np.stack([part, *(_mix(part ^ np.uint64(n)) for n in range(1, LANES))], axis=1)
        bits = np.unpackbits(lanes.view(np.uint8), bitorder="little").reshape(len(part), -1).astype(np.float32)
        counts += (np.ones(len(part), np.float32) @ bits).astype(np.int64)
    return np.packbits(counts * 2 > len(h), bitorder="little").tobytes()


def differing_share(similarity: float) -> float:
    """The expected share of differing bits of two equally large sets with this Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def differing_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int32)


def link_wide(fp: np.ndarray, most: int, apart: Callable[[np.ndarray, np.ndarray], np.ndarray] = differing_bits) -> np.ndarray:
    """For rows of 64-bit lanes the smallest row reachable by at most ``most`` differing bits (or another distance).

    Stars first: all that are near to a centre join it. Then only rows of different stars are compared, in blocks,
    so a group of near copies costs its size and a mixed run its square in plain distances.
    """
    n = len(fp)
    low, free, a, b = np.arange(n), np.ones(n, bool), [], []
    near = lambda i, at: apart(fp[at], fp[i]) <= most
    for i in range(n):
        if not free[i]:
            continue
        at = np.flatnonzero(free)
        hit = at[near(i, at)]
        free[hit] = False
        low[hit] = i
        if len(hit) == 1 and n <= 64:  # few rows: compared below
            continue
    stars, sizes = np.unique(low, return_counts=True)
    if len(stars) > 1:
        main = stars[sizes.argmax()]
        rest = np.flatnonzero(low != main)
        for i in rest:  # every pair of different stars has a side outside the largest one
            other = np.flatnonzero(low != low[i])
            other = other[(low[other] == main) | (other > i)]
            hit = other[near(i, other)]
            a.append(np.full(len(hit), i))
            b.append(hit)
    own = np.flatnonzero(low != np.arange(n))
    a.append(own)
    b.append(low[own])
    return forest(np.concatenate(a), np.concatenate(b), n)


#: Members of a group of candidates that are compared in one piece, and members that visit all pieces of a larger group.
PIECE, CENTRES = 128, 8


class Residents:
    """Shingle sets of a piece, and how like another set is to each of them (Jaccard, exact)."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(x) for x in sets])
        self.ends = np.cumsum(self.sizes)
        self.known, self.at = np.unique(np.concatenate(sets), return_inverse=True)

    def alike(self, one: np.ndarray, similarity: float) -> np.ndarray:
        if not len(self.known):
            return np.flatnonzero(self.sizes == len(one))
        i = np.minimum(np.searchsorted(self.known, one), len(self.known) - 1)
        mark = np.zeros(len(self.known), np.int64)
        mark[i[self.known[i] == one]] = 1
        total = np.r_[0, np.cumsum(mark[self.at])]
        both = total[self.ends] - total[self.ends - self.sizes]
        return np.flatnonzero(both / np.maximum(self.sizes + len(one) - both, 1) >= similarity)


def _links_in_pieces(rows: DataFrame, similarity: float, among: bool) -> DataFrame:
    """Edges ``(a, b)`` of rows ``(component, piece, visitor, node, own, shingles)`` that are alike in a piece.

    Visitors are compared with all residents, and residents with one another if ``among``; of residents known to
    be linked (equal ``own``) one edge is returned. Visitors are streamed, so a task holds the residents of a piece.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[int] = []
        b: list[int] = []
        at, nodes, sets, own, held = None, [], [], [], None

        def settle() -> Residents | None:
            if not nodes:
                return None
            r = Residents(sets)
            if among and len(nodes) > 1:
                hits = [r.alike(x, similarity) for x in sets]
                low = forest(np.repeat(np.arange(len(sets)), [len(h) for h in hits]), np.concatenate(hits), len(sets))
                for i in np.flatnonzero(low != np.arange(len(low))):
                    a.append(nodes[i])
                    b.append(nodes[low[i]])
                own[:] = [nodes[i] for i in low]
            return r

        for batch in batches:
            for component, piece, visitor, node, group, data in zip(*(c.to_pylist() for c in batch.columns)):
                if at != (component, piece):
                    if held is None:
                        settle()
                    at, nodes, sets, own, held = (component, piece), [], [], [], None
                x = np.frombuffer(data, np.uint64)
                if not visitor:
                    if not nodes or nodes[-1] != node:  # equal rows have equal nodes
                        nodes.append(node)
                        sets.append(x)
                        own.append(group)
                    continue
                held = settle() if held is None else held
                if held is not None:
                    for g, to in {own[i]: nodes[i] for i in held.alike(x, similarity)}.items():
                        if g != group:
                            a.append(node)
                            b.append(to)
            if len(a) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                a.clear()
                b.clear()
        if held is None:
            settle()
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("component", "piece", "visitor", "node", "own", "shingles").repartition(n, "component", "piece")
    return dealt.sortWithinPartitions("component", "piece", "visitor", "node").mapInArrow(run, "a long, b long")


def verified_components(docs: DataFrame, nodes: DataFrame, candidates: DataFrame, size: int, similarity: float) -> DataFrame:
    """``(node, component)`` by links of Jaccard ``similarity`` or above between nodes of the same candidate group.

    ``docs`` is ``(doc_id, t, text_key)``, ``nodes`` names a row of it for each node, ``candidates`` is ``(node,
    component)``. A group is cut into pieces of some PIECE members, compared among themselves and with some members
    that visit all pieces. What then is not in the largest component of its group visits all pieces too, so that
    every two members are compared but those already known to be in one component.
    """

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 3):
            sets = [np.unique(shingle_hashes(words_of(x.as_py()), size)).tobytes() for x in b.column(3)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(sets, pa.binary())], names=["node", "component", "n", "shingles"])

    groups = candidates.groupBy("component").agg(F.count("*").alias("n"))
    members = materialize(candidates.join(groups, "component").join(nodes.select("node", "first"), "node").select("node", "component", "n", F.col("first.doc_id").alias("id"), F.col("first.text_key").alias("tk")), "members")
    texts = docs.join(members, (F.col("text_key") == F.col("tk")) & F.col("doc_id").eqNullSafe(F.col("id"))).select("node", "component", "n", "t")
    sets = materialize(texts.mapInArrow(shingles, "node long, component long, n long, shingles binary"), "shingles")
    sets = sets.withColumn("pieces", F.expr(f"(n + {PIECE - 1}) div {PIECE}")).withColumn("home", F.expr("pmod(xxhash64(node), pieces)"))
    everywhere = F.expr("sequence(0L, pieces - 1)")
    residents = sets.withColumns({"piece": F.col("home"), "visitor": F.lit(False)})
    visits = lambda df: df.withColumn("piece", F.explode(everywhere)).where("piece <> home").withColumn("visitor", F.lit(True))
    centres = visits(sets.where(f"pieces > 1 and pmod(xxhash64(node, 1), n) < {CENTRES}"))
    links = materialize(_links_in_pieces(residents.unionByName(centres).withColumn("own", F.col("node")), similarity, True), "links")
    linked = connected_components(links)
    large = members.where(f"n > {PIECE}").select("node", "component").join(linked.withColumnRenamed("component", "own"), "node", "left").select("node", "component", F.coalesce("own", "node").alias("own"))
    large = materialize(large, "large")
    main = large.groupBy("component", "own").agg(F.count("*").alias("k")).groupBy("component").agg(F.max(F.struct("k", "own")).alias("m")).select("component", F.col("m.own").alias("main"))
    rest = large.join(main, "component").where("own <> main").select("node", "component")
    rest = materialize(rest, "rest")
    if rest.isEmpty():
        return linked
    open_ = rest.select("component").distinct()
    known = large.select("node", "own")
    again = residents.join(open_, "component", "left_semi").unionByName(visits(sets.join(rest.select("node"), "node", "left_semi"))).join(known, "node")
    return connected_components(links.unionByName(_links_in_pieces(again, similarity, False)))


def near_duplicate_groups(docs: DataFrame, size: int = 5, similarity: float = 0.8, slack: float = 0.048, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Groups of texts whose sets of shingles have a Jaccard similarity of ``similarity`` or above, directly or by others.

    Returns ``(doc_id, text_key, group)`` for every row and ``(group, first)`` for every group: ``first`` has the
    ``doc_id`` and ``text_key`` (XXH64 of the text) of its smallest row, rows without an id last. Rows are told apart
    by their text, not by their id; texts without words are alike.

    Wide fingerprints find candidates. At a similarity of 0.8 about 15 % of the bits differ, far beyond what equal
    groups of masks can promise, so the table's coordinates to single-bit variants are sampled: a bucket key is ``k``
    of them, and there are as many keys as leave ``MISSED`` of the pairs at the wanted similarity unmet. ``k`` follows
    the number of distinct fingerprints (buckets of some 32), so recall is the same at every size. Pairs of a bucket
    are candidates if their distance is at most the expected share of bits plus ``slack`` (three standard deviations);
    only exact similarities link them. A bucket of more than some ``HOT`` fingerprints goes to no task as a whole: all
    of it is one group of candidates, each member tied to the smallest by an aggregate and a join that AQE can split.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("t")).withColumn("text_key", F.xxhash64(F.coalesce("t", F.lit(b""))))

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            sets = [np.unique(shingle_hashes(words_of(x.as_py()), size)) for x in b.column(1)]
            node = np.array([xxhash.xxh64_intdigest(x.tobytes(), 42) for x in sets], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(node), pa.array([wide_fingerprint(x) for x in sets], pa.binary())], names=["doc_id", "text_key", "node", "fp"])

    own = materialize(docs.mapInArrow(prints, "doc_id long, text_key long, node long, fp binary"), "fingerprints")
    nodes = materialize(own.groupBy("node", "fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("void"), "doc_id", "text_key")).alias("first")), "nodes")
    n = nodes.count()
    share = differing_share(similarity)
    k = max(8, math.ceil(math.log2(max(n, 1))) - 5)
    tables = math.ceil(math.log(1 / MISSED) / (1 - share) ** k)
    most = int((share + slack) * 64 * LANES)
    chosen = np.random.default_rng(11).integers(0, 64 * LANES, (tables, k))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = 1 << np.arange(k, dtype=np.int64)
        for b in batches:
            fp = b.column(0).to_pylist()
            bits = np.unpackbits(np.frombuffer(b"".join(fp), np.uint8), bitorder="little").reshape(len(fp), -1)
            for t in range(tables):
                yield pa.RecordBatch.from_arrays([pa.array(bits[:, chosen[t]] @ weight * tables + t), b.column(0), b.column(1)], names=["key", "fp", "rep"])

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
        low = link_wide(np.frombuffer(b"".join([x[1] for x in held]), np.uint64).reshape(len(held), -1), most)
        at = np.flatnonzero(low != np.arange(len(low)))
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(rep[at]), pa.array(rep[low[at]])], names=["a", "b"])

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * tables // 500_000))
    keyed = lambda df: df.select("fp", F.col("node").alias("rep")).mapInArrow(keys, "key long, fp binary, rep long")
    counted = keyed(nodes.where(f"pmod(xxhash64(node), {COUNTED}) = 0")).groupBy("key").agg(F.count("*").alias("m"))
    hot = materialize(counted.where(f"m > {HOT / COUNTED}").select("key"), "hot")
    buckets, ties = keyed(nodes), None
    if not hot.isEmpty():
        tied = buckets.join(hot, "key", "left_semi").select("key", "rep")
        low = materialize(tied.groupBy("key").agg(F.min("rep").alias("b")), "smallest")
        ties = tied.join(low, "key").select(F.col("rep").alias("a"), "b")
        buckets = buckets.join(hot, "key", "left_anti")
    dealt = buckets.repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")
    candidates = connected_components(dealt if ties is None else dealt.unionByName(ties))
    cc = verified_components(docs, nodes, candidates, size, similarity)
    label = nodes.join(cc.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").select("node", F.coalesce("component", "node").alias("group"), "first")
    label = materialize(label, "groups")
    return own.join(label.select("node", "group"), "node").select("doc_id", "text_key", "group"), label.groupBy("group").agg(F.min("first").alias("first"))


def near_duplicate_components(docs: DataFrame, size: int = 5, similarity: float = 0.8, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(doc_id, component_id)`` for every row: the smallest doc_id of its group, null if no row of the group has one."""
    rows, groups = near_duplicate_groups(docs, size, similarity, text=text, key=key)
    return rows.join(groups, "group").select("doc_id", F.col("first.doc_id").alias("component_id"))
