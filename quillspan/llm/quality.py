"""Quality scores by a regularised quadratic discriminant over transformed document statistics.

Each whole text becomes a short vector of log ratios. The class moments (count, sum, sum of outer products) are
added up over all labelled rows of the training fold by partial aggregation, so the driver receives a fixed number
of sums and no rows. Class covariances are shrunk towards the pooled one and towards a multiple of the identity;
their Cholesky factors are computed once and sent with the scoring function, where a score is a difference of
Mahalanobis log densities.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize
from .words import slices

UPPER = bytes(range(65, 91))
DIGIT = bytes(range(48, 58))
SYMBOL = b"#$%&*@^~|<>{}[]\\/=+_`"
MARK = b"!?"
WIDE = bytes(range(128, 256))
STOP = b".,;:'\"()-"
NAMES = ("chars", "word_len", "upper", "digit", "symbol", "mark", "stop", "wide", "lines", "new_words", "new_pairs", "top_word", "short", "tailed", "odd_share", "same_lines")


def statistics(data: bytes | None) -> list[float]:
    """The vector of a whole text (UTF-8 bytes; null counts as empty), one number for each of ``NAMES``."""
    b = data or b""
    n = len(b)
    words = b.split()
    m = len(words)

    def share(k: float, of: float) -> float:
        return math.log((k + 0.5) / (of + 1.0))

    def count(chars: bytes) -> int:
        return n - len(b.translate(None, chars))

    freq = Counter(words)
    pairs = len(set(zip(words, words[1:])))
    lines = [x for x in b.split(b"\n") if x]
    symbol, mark = count(SYMBOL), count(MARK)
    tails = b"".join([w[-1:] for w in words])
    tailed = len(tails) - len(tails.translate(None, SYMBOL + MARK))
    short = sum([k for w, k in freq.items() if len(w) <= 3])
    # words that are a lone symbol, or capitals throughout with a mark: the shape of lists and of shouting
    odd = sum([k for w, k in freq.items() if len(w) == 1 and w in SYMBOL or w[-1:] in MARK or (len(w) > 3 and w.isupper())])
    return [
        math.log1p(n), math.log((n + 1.0) / (m + 1.0)), share(count(UPPER), n), share(count(DIGIT), n), share(symbol, n), share(mark, n),
        share(count(STOP), n), share(count(WIDE), n), share(len(lines), m),
        share(len(freq), m), share(pairs, m), share(max(freq.values(), default=0), m), share(short, m), share(tailed, m), share(odd, m),
        share(len(lines) - len(set(lines)), len(lines)),
    ]


@dataclass(frozen=True)
class Discriminant:
    """Means, lower Cholesky factors and log priors of classes 0 and 1, after standardising by ``centre`` and ``scale``."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    priors: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, higher: class 1 likelier. The log-odds are tempered (signed log) as the statistics depend on one another."""
        z = (x - self.centre) / self.scale
        logs = []
        for mean, factor, prior in zip(self.means, self.factors, self.priors):
            y = np.linalg.solve(factor, (z - mean).T)
            logs.append(prior - 0.5 * (y * y).sum(axis=0) - np.log(np.diag(factor)).sum())
        odds = logs[1] - logs[0]
        return 1.0 / (1.0 + np.exp(-np.sign(odds) * np.log1p(np.abs(odds))))


def discriminant(n: np.ndarray, s: np.ndarray, ss: np.ndarray, pooled_share: float = 0.4, ridge: float = 0.01) -> Discriminant:
    """From the class counts, sums and sums of outer products. A class without rows takes the moments of all rows."""
    d = s.shape[1]
    total = max(n.sum(), 1.0)
    centre = s.sum(axis=0) / total
    scale = np.sqrt(np.maximum(np.diag(ss.sum(axis=0)) / total - centre**2, 1e-6))
    means, covs = [], []
    for k in range(2):
        nk, sk, ssk = (n[k], s[k], ss[k]) if n[k] else (total, s.sum(axis=0), ss.sum(axis=0))
        mean = sk / max(nk, 1.0)
        covs.append((ssk / max(nk, 1.0) - np.outer(mean, mean)) / np.outer(scale, scale))
        means.append((mean - centre) / scale)
    pooled = (n[0] * covs[0] + n[1] * covs[1]) / total if n.sum() else np.eye(d)
    factors = []
    for cov in covs:
        cov = (1 - pooled_share) * cov + pooled_share * pooled
        cov = (1 - ridge) * cov + ridge * max(np.trace(cov) / d, 1e-3) * np.eye(d)
        factors.append(np.linalg.cholesky(cov))
    return Discriminant(centre, scale, np.array(means), np.array(factors), np.log((n + 1.0) / (total + 2.0)))


def document_statistics(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(doc_id, x array<double>)`` for every row; only the two columns are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            x = [statistics(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("t")).mapInArrow(run, "doc_id long, x array<double>")


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels are never learnt from. A null id counts as not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality") -> Discriminant:
    """Fit on all labelled rows that are not held out; labels other than 0 and 1 and null ids are ignored.

    A document with several label rows counts once for each. The driver receives a fixed number of sums.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & ~held_out())
    d = len(NAMES)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((2, 1 + d + d * d))
        for b in batches:
            y = b.column(0).to_numpy(zero_copy_only=False)
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            for k in range(2):
                z = x[y == k]
                out[k] += np.concatenate([[len(z)], z.sum(axis=0), (z.T @ z).ravel()])
        if out[:, 0].any():
            k, i = np.indices(out.shape)
            yield pa.RecordBatch.from_arrays([pa.array(k.ravel()), pa.array(i.ravel()), pa.array(out.ravel())], names=["k", "i", "v"])

    sums = stats.join(known, "doc_id").select("y", "x").mapInArrow(moments, "k long, i long, v double").groupBy("k", "i").agg(F.sum("v").alias("v"))
    out = np.zeros((2, 1 + d + d * d))
    for r in sums.collect():  # 2 x (1 + d + d^2) rows at most
        out[r.k, r.i] = r.v
    return discriminant(out[:, 0], out[:, 1 : 1 + d], out[:, 1 + d :].reshape(2, d, d))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``, repeated rows and all.

    Null and empty texts are scored as the empty text. Labels, language, source and id are no inputs of a score.
    Without usable labels all scores are 0.5. Extra columns of either table are not read; empty in, empty out.
    """
    stats = materialize(document_statistics(docs, text, key), "statistics")
    model = fit(stats, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    scored = stats.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def is_held_out(doc_id: int) -> bool:
    """The same fold on the driver's side."""
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, all columns unchanged, whose score is at least ``threshold``; no row is moved.

    The statistics are computed again where the row lies, which costs less than a shuffle of the texts. Null texts
    are judged as empty and returned as null if kept; repeated rows share their fate; empty in, empty out.
    """
    model = fit(document_statistics(docs, text, key), labels)
    at, names = docs.columns.index(text), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, at):
            x = np.array([statistics((t.as_py() or "").encode()) for t in b.column(at)])
            yield pa.RecordBatch.from_arrays(b.columns, names=names).filter(pa.array(model.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)
