"""Document fingerprints by randomised edit embedding.

Random walks shared by all texts (Chakraborty, Goldenberg and Koucky, 2016) read a text character by character: at
each step the walk shows the current character and moves on or stays, by a random bit of (step, character). Walks on
two texts that differ by an edit soon meet again, so edit distance becomes Hamming distance of what they show. The
embedding is sampled at shared random steps; each sample is hashed to a byte. A sample's step is the last record of a
shared random sequence below the text's number of steps, so texts of nearly equal length sample the same steps.

All texts of a block walk in step with one another (one numpy operation moves them all), longest first, and those
that have ended drop out: whole texts are read, with memory bounded by the block.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOTS = 128
#: Code points of a block of texts that walk together, and rows to a bucket at most, on average.
BLOCK_CHARS, BUCKET_ROWS = 10_000_000, 20_000
EMPTY = "00" * SLOTS


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64"""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _records() -> list[np.ndarray]:
    """For each slot the steps that are records of its shared random sequence."""
    rng = np.random.default_rng(20)
    out = []
    for _ in range(SLOTS):
        t, steps = 1, [0]
        while t < 1 << 42:
            t = int(t / (1.0 - rng.random())) + 1
            steps.append(t - 1)
        out.append(np.array(steps, dtype=np.int64))
    return out


RECORDS = _records()
TABLE = (_mix(np.arange(1 << 16, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def steps_of(n: np.ndarray) -> np.ndarray:
    """Steps after which a walk over n characters has reached the end, but for rare walks (half of the steps move)."""
    return 2 * n + 2 * np.ceil(np.sqrt(n)).astype(np.int64)


def walk(texts: list[str]) -> np.ndarray:
    """Fingerprints as bytes, a row for each text; zeros for an empty text."""
    out = np.zeros((len(texts), SLOTS), np.uint8)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    if not len(order):
        return out
    code = np.frombuffer("\0".join([texts[i] for i in order] + [""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    n = sizes[order]
    start = np.r_[0, np.cumsum(n + 1)[:-1]]
    shown = TABLE[(code ^ (code >> np.uint32(16))) & np.uint32(0xFFFF)]
    del code
    shown[start + n] = 0  # the end of a text: no move
    steps = steps_of(n)
    at = np.stack([r[np.searchsorted(r, steps) - 1] for r in RECORDS], axis=1)  # text x slot: the step that is sampled
    events = np.unique(at)
    seen = np.zeros((len(events), len(n)), np.uint32)
    alive = np.searchsorted(-steps, -events, side="left")  # texts with more steps than the event's number
    ptr = start.copy()
    now, k = 0, len(n)
    moved = np.empty(len(n), np.uint32)
    ended = np.searchsorted(-steps, -np.arange(0, steps[0], 64), side="left")  # texts still walking, looked up every 64 steps
    for e, (event, k_event) in enumerate(zip(events.tolist(), alive.tolist())):
        while now < event:
            stop = min(event, (now // 64 + 1) * 64)
            k = int(ended[now // 64])
            p, m = ptr[:k], moved[:k]
            for mult in (_mix(np.arange(now, stop, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1):
                shown.take(p, out=m, mode="clip")
                np.multiply(m, mult, out=m)
                np.right_shift(m, 31, out=m)
                np.add(p, m, out=p, casting="unsafe")
            now = stop
        seen[e, :k_event] = shown[ptr[:k_event]]
    slot = np.arange(SLOTS, dtype=np.uint64)
    for i in range(0, len(n), 4096):  # (step, slot, character) to a byte
        a = at[i : i + 4096]
        got = seen[np.searchsorted(events, a), np.arange(i, i + len(a))[:, None]].astype(np.uint64)
        out[order[i : i + 4096]] = (_mix(_mix(a.astype(np.uint64) * np.uint64(SLOTS) + slot) ^ got) >> np.uint64(56)).astype(np.uint8)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal samples, 0 to 1."""
    return (a == b).mean(axis=-1, dtype=np.float64)


def edited(text: str, other: str) -> str:
    """``text`` with its last third replaced by as many code points of ``other``, or all of it."""
    k = len(text) // 3
    return text[: len(text) - k] + other[:k]


def _tree(column: str, bounds: list[int], low: int = 0) -> str:
    """Nested IFs that give the number of bounds at or below the column, by halving."""
    if not bounds:
        return str(low)
    m = len(bounds) // 2
    return f"IF({column} < {bounds[m]}L, {_tree(column, bounds[:m], low)}, {_tree(column, bounds[m + 1 :], low + m + 1)})"


def fingerprint_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and likeness to that and to the next document.

    Returns ``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)``. The next
    document has the next lower doc_id (rows with equal ids by text; null ids last); after the last comes the
    first; a sole document is its own next. Null texts count as empty; an empty text's fingerprint is all zeros.
    Extra columns are not read; an empty table gives an empty result.

    Ids are cut into ranges at approximate quantiles; a range's first document is also sent to the range before it,
    so no task needs more than its own range and no row is collected.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = own.withColumn("k", F.coalesce("doc_id", F.lit(-(2**63) + 1)))
    n = own.count()
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // BUCKET_ROWS))
    cuts = own.select(F.percentile_approx("k", [i / ranges for i in range(1, ranges)], 10 * ranges).alias("q")).first().q if n and ranges > 1 else []
    own = own.withColumn("bucket", F.expr(_tree("k", sorted(set(cuts or [])))))
    first = sorted((r.bucket, r.k) for r in own.groupBy("bucket").agg(F.max("k").alias("k")).collect())  # a row for each range
    top = {b: k for b, k in first}
    before = {b: first[i + 1][0] if i + 1 < len(first) else first[0][0] for i, (b, _) in enumerate(first)}
    tops = ", ".join(f"{top.get(b, 0)}L" for b in range(ranges))
    befores = ", ".join(str(before.get(b, 0)) for b in range(ranges))
    dealt = own.select("doc_id", "text", "k", F.expr(
        f"explode(IF(k = element_at(array({tops}), bucket + 1), array(struct(bucket, 0 AS tail), struct(element_at(array({befores}), bucket + 1) AS bucket, 1 AS tail)), array(struct(bucket, 0 AS tail)))) AS b"))
    dealt = dealt.select("b.bucket", "b.tail", "k", "doc_id", "text").repartitionById(ranges, F.col("bucket"))
    out = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.sortWithinPartitions("bucket", "tail", F.desc("k"), "text").select("tail", "doc_id", "text").mapInArrow(_fingerprint_range, out)


def _fingerprint_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids: list[int | None] = []
    texts: list[str] = []
    chars, done = 0, False
    for b in batches:
        for tail, doc, text in zip(*(c.to_pylist() for c in b.columns)):
            if done:
                continue  # further rows with the tail's id
            texts.append(text)
            if tail:
                yield _block(ids, texts)
                done = True
                continue
            ids.append(doc)
            chars += 2 * len(text)
            if chars >= BLOCK_CHARS and len(ids) > 1:  # the last one is the next of the one before it
                yield _block(ids[:-1], texts)
                ids, texts, chars = ids[-1:], texts[-1:], 2 * len(text)


def _block(ids: list[int | None], texts: list[str]) -> pa.RecordBatch:
    """Rows for all of ``ids``; ``texts`` has one more, the next document of the last."""
    changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
    fp = walk(texts + changed)
    plain, new = fp[: len(texts)], fp[len(texts) :]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
            pa.array([x.tobytes().hex() for x in plain[:-1]]), pa.array([x.tobytes().hex() for x in new]),
            pa.array(likeness(plain[:-1], new)), pa.array(likeness(plain[:-1], plain[1:])),
        ],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )
