"""Removal of passages that recur, by repeated-phrase automata.

A window is 35 consecutive words. Every window picks one of its 8-word phrases as its anchor (the least by hash), so
equal windows have equal anchors. The steps:

1. Count anchors over all documents; those that occur again are marked in a bitmap of fixed size. A clash of bits, or
   a bitmap that fills up, only lets more segments through.
2. Each document is cut into segments, the words of the windows that picked a marked anchor, and the segments are dealt
   to shards by anchor. What is left out has no window that could recur.
3. A shard confirms its recurring passages: windows that start in two places are joined to the longest runs whose
   windows occur together wherever one of them does, and each run is cut from the first text that has it, once.
4. The passages are compiled to an Aho-Corasick automaton over words, and all segments of the shard are streamed through
   it: it finds every occurrence, word for word. The ranges go back to the documents.

A task that meets an equal segment again (two 64-bit hashes) sends its count alone, and knows that its words recur.
Anchors with more segments than a task can hold are first collapsed to distinct segments; if there still are too many
different ones (a frequent phrase in ever new surroundings), their windows are counted one by one over the cluster
(two 64-bit hashes each) and joined back. No step holds all occurrences of anything in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .editprint import _mix
from .shared import materialize, unused
from .words import gather, give_back, slices, split_words

WINDOW, PHRASE = 35, 8
#: Bits of the bitmap of recurring anchors: 16 MB, whatever the input.
BITS = 1 << 27
#: Segments to a task on average, those of whole anchors compiled and streamed at a time, those of one anchor at most,
#: and those a task remembers to have sent.
TASK_SEGMENTS, CHUNK, HOT, SENT = 60_000, 8_000, 20_000, 200_000
_B = [pow(0x9E3779B97F4A7C15, m, 1 << 64) for m in range(WINDOW)]
_INVERSE = pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def _run_hashes(w: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hash of each run of ``size`` words, built by doubling."""
    out, done, power, m = None, 0, w, 1
    left = size
    while left:
        if left & 1:
            out = power.copy() if out is None else out[: len(power) - done] * np.uint64(_B[m]) + power[done : done + len(out[: len(power) - done])]
            done += m
        left >>= 1
        if left:
            power = power[: len(power) - m] * np.uint64(_B[m]) + power[m:]
            m *= 2
    return _mix(out[: len(w) - size + 1])


class Words:
    """The words of some texts one after another: ``words``, their numbers ``codes`` and ``hashes``; text i has those
    from ``offsets[i]`` to ``offsets[i + 1]``."""

    def __init__(self, texts: pa.Array) -> None:
        words, offsets = split_words(texts)
        numbered = words.dictionary_encode()
        self.words, self.offsets = words, offsets
        self.codes = numbered.indices.to_numpy(zero_copy_only=False)
        each = [xxhash.xxh64_intdigest(w) for w in numbered.dictionary.to_pylist()]
        self.hashes = np.array(each, dtype=np.uint64)[self.codes] if each else np.zeros(0, np.uint64)

    def windows(self) -> np.ndarray:
        """Starts of all windows; none goes beyond its text."""
        sizes = np.diff(self.offsets)
        return np.flatnonzero(np.repeat(self.offsets[1:], sizes) - np.arange(self.offsets[-1]) >= WINDOW)

    def window_hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of all windows."""
        at = self.windows()
        return at, _run_hashes(self.hashes, WINDOW)[at].view(np.int64) if len(at) else np.zeros(0, np.int64)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchors of runs of windows that pick the same phrase: its hash, the first window, and how many there are."""
        at = self.windows()
        if not len(at):
            return at, at, at
        v = _run_hashes(self.hashes, PHRASE)
        low, pick = v, np.arange(len(v))  # of ties the first: equal windows then pick alike, and no two of them one phrase

        def least(low: np.ndarray, pick: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
            later = low[m:] < low[: len(low) - m]
            return np.where(later, low[m:], low[: len(low) - m]), np.where(later, pick[m:], pick[: len(low) - m])

        size, m = WINDOW - PHRASE + 1, 1
        while 2 * m <= size:
            low, pick = least(low, pick, m)
            m *= 2
        pick = least(low, pick, size - m)[1][at]
        new = np.flatnonzero(np.r_[True, (pick[1:] != pick[:-1]) | (at[1:] != at[:-1] + 1)])
        return v[pick[new]].view(np.int64), at[new], np.diff(np.r_[new, len(at)])

    def spans(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Hashes of runs of words of any size, from sums of powers."""
        with np.errstate(over="ignore"):
            power = np.multiply.accumulate(np.r_[np.uint64(1), np.full(len(self.hashes), _B[1], np.uint64)])
            back = np.multiply.accumulate(np.r_[np.uint64(1), np.full(len(self.hashes), _INVERSE, np.uint64)])
            total = np.r_[np.uint64(0), np.cumsum(_mix(self.hashes) * power[:-1], dtype=np.uint64)]
            return _mix((total[start + size] - total[start]) * back[start] + size.astype(np.uint64)).view(np.int64)

    def joined(self, start: np.ndarray, size: np.ndarray) -> pa.Array:
        """Texts of runs of words, joined by one space."""
        taken = self.words.take(pa.array(gather(start, size)))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)], pa.int32()), taken), " ")


def _slices(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, Words]]:
    for part in slices(batches, text):
        yield part, Words(part.column(text))


def text_key(text: str) -> Column:
    return F.xxhash64(F.col(text))


def _anchor_counts(docs: DataFrame, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, words in _slices(batches, 0):
            yield pa.RecordBatch.from_arrays([pa.array(words.anchors()[0], pa.int64())], names=["anchor"])

    return docs.select(F.col(text).cast("string").alias("t")).mapInArrow(run, "anchor long").groupBy("anchor").agg(F.count("*").alias("n"))


def _bitmap(spark: SparkSession, counts: DataFrame) -> bytes:
    """Bits of the anchors that occur again; at most BITS / 64 rows reach the driver."""
    bit = F.pmod("anchor", F.lit(BITS))
    rows = (
        counts.where("n > 1")
        .select((bit / 64).cast("int").alias("at"), F.expr(f"shiftleft(1L, cast(pmod(anchor, 64) as int))").alias("b"))
        .groupBy("at").agg(F.bit_or("b").alias("b")).toArrow()
    )
    out = np.zeros(BITS // 64, np.int64)
    out[rows.column("at").to_numpy()] = rows.column("b").to_numpy()
    return out.tobytes()


def _equal(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups of equal keys: the first index of each, the group of each index, and the groups' sizes."""
    o = np.lexsort(keys[::-1])
    new = np.r_[True, np.logical_or.reduce([k[o][1:] != k[o][:-1] for k in keys])] if len(o) else np.zeros(0, bool)
    of = np.empty(len(o), np.int64)
    of[o] = np.cumsum(new) - 1
    start = np.flatnonzero(new)
    return (np.minimum.reduceat(o, start) if len(o) else start), of, np.bincount(of, minlength=len(start))


SEGMENTS = "anchor long, span long, n long, doc_id long, text_key long, first int, stop int, seg string"


def _segments(docs: DataFrame, text: str, key: str, bitmap) -> DataFrame:
    """Occurrences of marked anchors, combined where they are found.

    If a task meets an equal segment again, all windows of both recur: the later one's words are a range already
    (``first``, ``stop``; no anchor) and only its count goes on (``n``; no ``first``). The first one is still open, and
    carries the segment's text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap.value, dtype=np.uint64)
        sent: set[tuple[int, int]] = set()
        for part, words in _slices(batches, 2):
            anchor, start, n = words.anchors()
            at = anchor.view(np.uint64) & np.uint64(BITS - 1)
            hit = np.flatnonzero((bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1))
            if not len(hit):
                continue
            anchor, start, size = anchor[hit], start[hit], n[hit] + WINDOW - 1
            span = words.spans(start, size)
            row = np.searchsorted(words.offsets, start, side="right") - 1
            one, of, count = _equal(anchor, span)
            if len(sent) > SENT:
                sent = set()
            each = list(zip(anchor[one].tolist(), span[one].tolist()))
            old = np.fromiter((k in sent for k in each), bool, len(each))
            sent.update(compress(each, (~old).tolist()))
            place = np.where(old, -1, np.cumsum(~old) - 1)
            seg = words.joined(start[one[~old]], size[one[~old]]).take(pa.array(place, mask=old))
            again = old[of] | (np.arange(len(of)) != one[of])
            # one row for each distinct segment, open if its first occurrence here is the task's first
            ids = pa.array(row[one], mask=old)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor[one]), pa.array(span[one]), pa.array(count, pa.int64()), part.column(0).take(ids), part.column(1).take(ids),
                 pa.array((start - words.offsets[row])[one], pa.int32(), mask=old), pa.nulls(len(one), pa.int32()), seg], names=NAMES)
            r, s, e = row[again], start[again], (start + size)[again]
            if len(r):
                new = np.r_[True, (r[1:] != r[:-1]) | (s[1:] > e[:-1])]
                last = np.r_[np.flatnonzero(new)[1:] - 1, len(r) - 1]
                r, s, e = r[new], s[new] - words.offsets[r[new]], e[last] - words.offsets[r[new]]
                ids, none = pa.array(r), pa.nulls(len(r), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, none, part.column(0).take(ids), part.column(1).take(ids), pa.array(s, pa.int32()), pa.array(e, pa.int32()), pa.nulls(len(r), pa.string())], names=NAMES)

    NAMES = [f.split()[0] for f in SEGMENTS.split(", ")]
    return docs.select(F.col(key).cast("long").alias("doc_id"), text_key(text).alias("text_key"), F.col(text).cast("string").alias("t")).mapInArrow(run, SEGMENTS)


def passages(words: Words, anchor: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Confirmed passages of distinct segments (of whole anchors), as runs [start, stop) of ``words``.

    A window recurs if it starts in two places, ``n`` being how often a segment occurs. Consecutive windows are joined
    if they follow one another wherever either occurs. A passage is cut from the first segment that has it; the other
    places are left for the automaton to find.
    """
    at, h = words.window_hashes()
    if not len(at):
        return at, at
    row = np.searchsorted(words.offsets, at, side="right") - 1
    first, of, size = _equal(anchor[row], h)
    total = np.bincount(of, n[row], len(first))
    follows = np.r_[(at[1:] == at[:-1] + 1) & (row[1:] == row[:-1]), False]
    after = np.where(follows, np.r_[of[1:], 0], -1)  # the window that comes next in the same segment
    low, high = np.full(len(first), len(first)), np.full(len(first), -1)
    np.minimum.at(low, of, after)
    np.maximum.at(high, of, after)
    recurs = total > 1
    joined = (low == high) & (low >= 0)  # always followed by one and the same window
    joined[joined] = (size[low[joined]] == size[joined]) & recurs[low[joined]]
    own = np.sort(first[recurs])  # windows of passages, each where it occurs first
    if not len(own):
        return own, own
    goes_on = np.r_[False, (own[1:] == own[:-1] + 1) & joined[of[own[:-1]]]]
    begin = np.flatnonzero(~goes_on)
    end = np.r_[begin[1:], len(own)] - 1
    return at[own[begin]], at[own[end]] + WINDOW


def locate(codes: np.ndarray, offsets: np.ndarray, found: list[tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text, start, stop)``: word ranges of every occurrence of the passages in the texts, merged where they overlap.

    Text i has the word numbers ``codes[offsets[i]:offsets[i + 1]]``; all texts are streamed in one pass.
    """
    none = np.zeros(0, np.int64)
    if not found:
        return none, none, none
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
    for p in found:
        automaton.add_word(p)
    automaton.make_automaton()
    wall = int(codes.max()) + 1  # between texts, in no passage
    hits = list(automaton.iter(tuple(np.insert(codes, offsets[1:-1], wall).tolist())))
    if not hits:
        return none, none, none
    last, size = np.array(hits, np.int64).T
    begins = offsets[:-1] + np.arange(len(offsets) - 1)  # with the walls before
    text = np.searchsorted(begins, last, side="right") - 1
    start, stop = last + 1 - size, last + 1
    o = np.argsort(start, kind="stable")
    text, start, stop = text[o], start[o], stop[o]
    reach = np.maximum.accumulate(stop)
    new = np.r_[True, start[1:] > reach[:-1]]  # the wall keeps texts apart
    end = np.r_[np.flatnonzero(new)[1:] - 1, len(new) - 1]
    return text[new], start[new] - begins[text[new]], reach[end] - begins[text[new]]


def _located(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Ranges of the recurring passages in segments ``(anchor, span, n, seg)`` of whole anchors, sorted by the first two."""
    anchor, span, n = (rows.column(i).to_numpy() for i in range(3))
    new = np.r_[True, (anchor[1:] != anchor[:-1]) | (span[1:] != span[:-1])]
    start = np.flatnonzero(new)
    seg = rows.column(3).combine_chunks()
    full = np.where(seg.is_valid().to_numpy(zero_copy_only=False), np.arange(len(anchor)), len(anchor))
    words = Words(seg.take(pa.array(np.minimum.reduceat(full, start))))
    anchor, span, n = anchor[start], span[start], np.add.reduceat(n, start)
    codes = words.codes.tolist()
    found = [tuple(codes[s:e]) for s, e in zip(*(x.tolist() for x in passages(words, anchor, n)))]
    text, first, stop = locate(words.codes, words.offsets, found)
    if len(text):
        yield pa.RecordBatch.from_arrays([pa.array(anchor[text]), pa.array(span[text]), pa.array(first, pa.int32()), pa.array(stop, pa.int32())], names=["anchor", "span", "start", "stop"])


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments in order of anchor; some thousand of them, of whole anchors, at a time."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) < CHUNK:
            continue
        rows = pa.Table.from_batches(held).combine_chunks()
        anchor = rows.column(0).to_numpy()
        cut = int(np.searchsorted(anchor, anchor[-1]))
        if cut:
            for i in _cuts(anchor[:cut]):
                yield from _located(rows.slice(*i))
            held = rows.slice(cut).to_batches()
    if sum(x.num_rows for x in held):
        rows = pa.Table.from_batches(held).combine_chunks()
        for i in _cuts(rows.column(0).to_numpy()):
            yield from _located(rows.slice(*i))
    give_back()


def _cuts(anchor: np.ndarray) -> Iterator[tuple[int, int]]:
    """Parts (start, length) of some CHUNK rows that end where an anchor ends."""
    at = 0
    while at < len(anchor):
        end = at + CHUNK
        end = len(anchor) if end >= len(anchor) else int(np.searchsorted(anchor, anchor[end - 1], side="right"))
        yield at, end - at
        at = end


def _windows(segments: DataFrame) -> DataFrame:
    """``(anchor, span, n, start, h, g)``: the windows of segments, told by two hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words in _slices(batches, 3):
            at, h = words.window_hashes()
            row = np.searchsorted(words.offsets, at, side="right") - 1
            g = words.spans(at, np.full(len(at), WINDOW)) if len(at) else h
            of = pa.array(row)
            yield pa.RecordBatch.from_arrays([*(part.column(i).take(of) for i in range(3)), pa.array(at - words.offsets[row], pa.int32()), pa.array(h, pa.int64()), pa.array(g, pa.int64())], names=["anchor", "span", "n", "start", "h", "g"])

    return segments.select("anchor", "span", "n", "seg").mapInArrow(run, "anchor long, span long, n long, start int, h long, g long")


def repeated_ranges(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(doc_id, text_key, start, stop)``: word ranges covered by recurring windows; ranges of a document may overlap."""
    spark = docs.sparkSession
    bitmap = spark.sparkContext.broadcast(_bitmap(spark, _anchor_counts(docs, text)))
    segments = materialize(_segments(docs, text, key, bitmap), "segments")
    bitmap.destroy()
    rows = segments.where("anchor is not null").select("anchor", "span", "n", "seg")
    busy = materialize(rows.groupBy("anchor").agg(F.count("*").alias("m")).where(f"m > {HOT}").select("anchor"), "busy")
    exact = None
    if not busy.isEmpty():
        # collapsed over all tasks; what then is in reach of a task goes the same way as the rest
        distinct = rows.join(busy, "anchor", "left_semi").groupBy("anchor", "span").agg(F.sum("n").alias("n"), F.first("seg", ignorenulls=True).alias("seg"))
        distinct = materialize(distinct, "distinct")
        hot = distinct.groupBy("anchor").agg(F.count("*").alias("m")).where(f"m > {HOT}").select("anchor")
        rows = rows.join(busy, "anchor", "left_anti").unionByName(distinct.join(hot, "anchor", "left_anti"))
        windows = _windows(distinct.join(hot, "anchor", "left_semi"))
        again = windows.groupBy("h", "g").agg(F.sum("n").alias("m")).where("m > 1").select("h", "g")
        exact = windows.join(again, ["h", "g"], "left_semi").selectExpr("anchor", "span", "start", f"start + {WINDOW} AS stop")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-segments.count() // TASK_SEGMENTS))
    located = rows.repartition(tasks, "anchor").sortWithinPartitions("anchor", "span").mapInArrow(_shard, "anchor long, span long, start int, stop int")
    located = located.unionByName(exact) if exact is not None else located
    open_ = segments.where("anchor is not null and first is not null").select("anchor", "span", "doc_id", "text_key", "first")
    ranges = open_.join(located, ["anchor", "span"]).selectExpr("doc_id", "text_key", "first + start AS start", "first + stop AS stop")
    return segments.where("anchor is null").selectExpr("doc_id", "text_key", "first AS start", "stop").unionByName(ranges)


def drop_repeated(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """All columns of ``docs`` with ``n_words``, ``n_removed`` and ``kept`` (remaining words joined by one space).

    Words lie between ASCII white space and are compared unchanged. Each word covered by a window whose word sequence
    also starts anywhere else, in the same document too, is removed; windows are judged on the input. Null texts count
    as having no words; texts of fewer than 35 words keep all. Repeated rows and ties are judged like any other rows
    (rows with equal id and text recur in one another). Columns named like the three new ones are replaced. Empty in,
    empty out.
    """
    id_, own_key, own_ranges = unused(docs.columns, "id", "text_key", "ranges")
    ranges = repeated_ranges(docs, text, key).groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "stop")).alias("ranges"))
    own = docs.select([F.col(f"`{c}`") for c in docs.columns if c not in ("n_words", "n_removed", "kept")])
    own = own.withColumns({id_: F.coalesce(F.col(key).cast("long"), F.lit(-(2**63) + 1)), own_key: text_key(text)})
    ranges = ranges.select(F.coalesce("doc_id", F.lit(-(2**63) + 1)).alias(id_), F.col("text_key").alias(own_key), F.col("ranges").alias(own_ranges))
    joined = own.join(ranges, [id_, own_key], "left").drop(id_, own_key)
    at, n = joined.columns.index(text), len(joined.columns) - 1
    keep = [c for c in joined.columns if c != own_ranges]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, at):
            rows: list[tuple[int, int, str]] = []
            for t, ranges in zip(b.column(at), b.column(n)):
                words = (t.as_py() or "").encode().split()
                stay = np.ones(len(words), bool)
                for r in ranges.as_py() or ():
                    stay[r["start"] : r["stop"]] = False
                left = words if stay.all() else list(compress(words, stay.tolist()))
                rows.append((len(words), len(words) - len(left), b" ".join(left).decode()))
            c = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.string())], names=[*keep, "n_words", "n_removed", "kept"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema if f.name != own_ranges)
    return joined.select(*[F.col(f"`{c}`") for c in keep], own_ranges).mapInArrow(run, f"{fields}, n_words long, n_removed long, kept string")
