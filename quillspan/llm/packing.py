"""Packing of tokenised documents into fixed windows by minimum bin slack.

Texts are tokenised where they lie; a document longer than a window is cut into whole windows and a remainder. All
that the packing needs to know is how many remainders there are of each length, which is at most one number for each
length. On these counts the driver fills windows: a bitset subset-sum (a big integer whose bit s says that s is
reachable) finds the fill closest to capacity, backtracking over the bitsets gives the multiset of lengths, and the
multiset is used as often as the counts allow. Remainders are then numbered within their length and look up their
place. No row goes to the driver and no length, however common, goes to one task.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize
from .words import gather, slices, split_words

CAPACITY, END = 4096, 2
#: Rows that are numbered together within a length, at most on average.
NUMBERED = 50_000
#: Rows that one task numbers, at most on average.
TASK_ROWS = 2_000_000
#: Distinct parts of words whose ids a worker remembers, but for those of one slice.
REMEMBERED = 200_000


def _plain_letters() -> str:
    """A class of letters that normalisation leaves alone and that have one letter each for their lower case."""
    same = lambda c: unicodedata.normalize("NFC", c) == c and unicodedata.category(c)[0] == "L"
    return "".join(c for c in map(chr, range(0x500)) if same(c) and len(c.lower()) == 1 and same(c.lower()))


#: A word's last letter and the ASCII marks after it (but for the apostrophe, which begins parts of its own).
CLOSED = rf"([{_plain_letters()}])([!-&(-/:-@\[-`{{-~]+)$"


class Encoder:
    """Ids of texts, each with the closing id.

    The tokenizer normalises, lowers case and drops white space, and none of its rules reaches across ASCII white space
    or from a letter into the punctuation after it, unless normalising gives the letter a mark of its own. So a text's
    ids are those of its words, and a word's ids those of its letters and of its closing marks where its last letter is
    one that normalising leaves alone; other words, and those that may hold one of the tokenizer's own marks, are
    encoded as they are. Each distinct part is encoded once and remembered, in flat arrays of bounded size.
    """

    def __init__(self, tokenizer) -> None:
        self.tokenizer = tokenizer
        vocabulary = tokenizer.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts, one after another, and how many each has.

        Parts of lower-case letters have one word end each, so they are encoded as lines of many; a line whose ends
        do not come out as its words is encoded one by one, like all other parts.
        """
        plain = pc.match_substring_regex(pa.array(parts, pa.string()), r"^\p{Ll}+$").to_numpy(zero_copy_only=False)
        at, rest = np.flatnonzero(plain), [np.flatnonzero(~plain)]
        ids, order, sizes = [np.zeros(0, np.uint32)], [], []
        lines = [at[i : i + 200] for i in range(0, len(at), 200)]
        for line, e in zip(lines, self.tokenizer.encode_batch_fast([" ".join([parts[i] for i in line]) for line in lines], add_special_tokens=False)):
            got = np.array(e.ids, np.uint32)
            ends = np.flatnonzero(self.closes[got]) + 1
            if len(ends) == len(line) and ends[-1] == len(got):
                ids.append(got)
                order.append(line)
                sizes.append(np.diff(ends, prepend=0))
            else:
                rest.append(line)
        alone = np.concatenate(rest)
        for i in range(0, len(alone), 1000):
            some = [e.ids for e in self.tokenizer.encode_batch_fast([parts[k] for k in alone[i : i + 1000]], add_special_tokens=False)]
            ids.append(np.fromiter(chain.from_iterable(some), np.uint32))
            order.append(alone[i : i + 1000])
            sizes.append(np.array([len(x) for x in some], np.int64))
        done, n = np.concatenate([np.zeros(0, np.int64), *order]), np.concatenate([np.zeros(0, np.int64), *sizes])
        back = np.argsort(done)
        return np.concatenate(ids)[gather((np.cumsum(n) - n)[back], n[back])], n[back]

    def parts(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the known parts of each of ``words``, one after another; where each word's begin; how many."""
        low = pc.if_else(pc.string_is_ascii(words), pc.ascii_lower(words), words)
        apart = pc.replace_substring_regex(low, CLOSED, r"\1 \2")
        low, offsets = split_words(pc.if_else(pc.match_substring(words, "|>"), words, apart))  # "|>": may be a mark
        numbered = low.dictionary_encode()
        distinct = numbered.dictionary.to_pylist()
        if len(self.known) > REMEMBERED:
            self.forget()
        new = [w for w in distinct if w not in self.known]
        if new:
            ids, sizes = self.encode(new)
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.ids = np.concatenate([self.ids, ids])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        at = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))
        return at[numbered.indices.to_numpy(zero_copy_only=False)], offsets[:-1], np.diff(offsets)

    def __call__(self, texts: pa.Array) -> Iterator[np.ndarray]:
        words, offsets = split_words(texts)
        numbered = words.dictionary_encode()
        codes = numbered.indices.to_numpy(zero_copy_only=False)
        part, start, many = self.parts(numbered.dictionary)
        of = part[gather(start[codes], many[codes])]  # known parts of all words
        n = self.ends[of + 1] - self.ends[of]
        ids = self.ids[gather(self.ends[of], n)]
        ends = np.r_[0, np.cumsum(n)][np.r_[0, np.cumsum(many[codes])][offsets]]
        for s, e in zip(ends.tolist(), ends[1:].tolist()):
            out = np.empty(e - s + 1, np.uint32)
            out[:-1], out[-1] = ids[s:e], END
            yield out


@lru_cache(maxsize=1)
def encoder(tokenizer_file: str) -> Encoder:
    """One for each worker: tasks that follow one another there share what it remembers."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores already
    from tokenizers import Tokenizer

    return Encoder(Tokenizer.from_file(tokenizer_file))


def pieces(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, with_ids: bool = False, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row for each piece: ``(doc_id, start, length, ids_crc32, doc_tokens, row)``, and ``ids`` if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_file)
        for part in slices(batches, 2):
            rows: list[tuple] = []
            for doc, row, ids in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), encode(part.column(2))):
                for s in range(0, len(ids), capacity):
                    p = ids[s : s + capacity]
                    rows.append((doc, s, len(p), zlib.crc32(p.astype("<u4").tobytes()), len(ids), row, *([p.tolist()] if with_ids else [])))
            c = list(zip(*rows))
            types = [pa.int64()] * 6 + [pa.list_(pa.int64())] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, types)], names=NAMES[: len(types)])

    NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "row", "ids"]
    schema = ", ".join(f"{n} long" for n in NAMES[:6]) + ", ids array<bigint>" * with_ids
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text).cast("string").alias("t")).mapInArrow(run, schema)


def fullest(counts: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """The multiset of lengths, within the counts, whose sum is closest to capacity from below: [(length, times)].

    Counts are taken in binary parts (1, 2, 4, ...), each one shift of the bitset; the bitsets before each part are
    kept for backtracking. It stops early once capacity is reached.
    """
    mask = (1 << (capacity + 1)) - 1
    reach, steps = 1, []
    for length in sorted(counts, reverse=True):
        left, part = min(counts[length], capacity // length), 1
        while left:
            k = min(part, left)
            steps.append((reach, length, k))
            reach |= (reach << (length * k)) & mask
            left -= k
            part *= 2
        if reach >> capacity:
            break
    fill = reach.bit_length() - 1
    used: dict[int, int] = {}
    for before, length, k in reversed(steps):
        if not before >> fill & 1:
            used[length] = used.get(length, 0) + k
            fill -= length * k
    return sorted(used.items(), reverse=True)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Windows as [(how many, multiset)], all counts used up. Each step uses up a length or nearly so."""
    left = {k: n for k, n in counts.items() if n > 0}
    out = []
    while left:
        chosen = fullest(left, capacity)
        times = min(left[k] // n for k, n in chosen)
        out.append((times, chosen))
        for k, n in chosen:
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return out


def places(windows: list[tuple[int, list[tuple[int, int]]]], first: int) -> dict[int, tuple[list[int], list[tuple[int, int, int]]]]:
    """For each length: the ranks at which entries begin, and entries (pieces to a window, first window, offset)."""
    out: dict[int, tuple[list[int], list[tuple[int, int, int]]]] = {}
    used: dict[int, int] = {}
    for times, chosen in windows:
        offset = 0
        for length, n in chosen:
            starts, entries = out.setdefault(length, ([], []))
            starts.append(used.get(length, 0))
            entries.append((n, first, offset))
            used[length] = used.get(length, 0) + n * times
            offset += n * length
        first += times
    return out


def pack(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, with_ids: bool = False, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)`` for each piece of each row of ``docs``.

    Each id of each document, and its closing id, lies in exactly one piece; each sequence is filled from offset 0
    without gaps. Null and empty texts are a lone closing id. Repeated rows are packed as often as they occur; null
    ids are kept. Ids are those of the tokenizer as its file has it: its marks (``<|endoftext|>``) that stand in a text
    become their own ids. Ties between equal lengths are broken by the rows' order of storage, so a rerun packs alike.
    ``with_ids`` adds the ids themselves. Extra columns are not read; empty in, empty out.
    """
    spark = docs.sparkSession
    own = materialize(pieces(docs, tokenizer_file, capacity, with_ids, text, key), "pieces")
    counts = {int(r.length): int(r.n) for r in own.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    total = sum(counts.values())
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    most = max(1, min(NUMBERED, total // (4 * tasks)))  # a common length is numbered in many splits, a rare one in one
    splits = ", ".join(str(-(-counts.get(k, 0) // most) or 1) for k in range(1, capacity + 1))
    windows = plan({k: n for k, n in counts.items() if k < capacity}, capacity)
    where = places([(counts.get(capacity, 0), [(capacity, 1)]), *windows], 0)
    table = spark.sparkContext.broadcast(where)  # entries: some for each length, whatever the number of rows

    # number the pieces of a length: within (length, split), after the pieces of the splits before
    own = own.withColumn("split", F.expr(f"cast(pmod(xxhash64(row, start), element_at(array({splits}), cast(length AS int))) AS int)"))
    sizes = own.groupBy("length", "split").agg(F.count("*").alias("n"))
    names = [c for c in own.columns if c not in ("row", "split")]
    before = Window.partitionBy("length").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("length", "split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # a row for each split
    joined = own.join(base, ["length", "split"]).select("length", "split", "base", "row", *[c for c in names if c != "length"])
    dealt = joined.repartition(max(tasks, total // TASK_ROWS), "length", "split").sortWithinPartitions("length", "split", "row", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rank = None, 0
        for b in batches:
            length, split, base = (b.column(i).to_pylist() for i in range(3))
            seq, off = [], []
            for k, s, o in zip(length, split, base):
                if (k, s) != at:
                    at, rank = (k, s), o
                starts, entries = table.value[k]
                i = bisect_right(starts, rank) - 1
                n, first, offset = entries[i]
                w, slot = divmod(rank - starts[i], n)
                seq.append(first + w)
                off.append(offset + slot * k)
                rank += 1
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in names] + [pa.array(seq, pa.int64()), pa.array(off, pa.int64())], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"{c} {'array<bigint>' if c == 'ids' else 'long'}" for c in names) + ", sequence_id long, offset long"
    return dealt.mapInArrow(run, schema)
