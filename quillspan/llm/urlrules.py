"""Prefix rules for urls by a sort-merge range join.

A host is written with its labels reversed (``www.example.com`` -> ``com.example.www.``), so a rule for a host and
all its subdomains is one interval of the sorted keys, and intervals of two rules nest or are apart. Rules and urls
are dealt to buckets of the key order, sorted together, and swept once with a stack of the rules that are active at
the current key; the url's path then picks among them.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (host, path, verdict)
PRODUCTION_RULES = [
    ("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"),
]
#: Urls whose keys are sampled for bucket bounds (balance only, no effect on results), and rows to a bucket.
SAMPLE, BUCKET_ROWS = 20_000, 200_000
NAMES = ["bucket", "key", "kind", "page_id", "host", "path", "verdict"]
DEALT = "bucket int, key string, kind int, page_id long, host string, path string, verdict string"
OUT = "page_id long, host string, path string, rule string, verdict string"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if null or without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(/[^?#]*)", 1), F.lit(""))


def key_of(host: Column) -> Column:
    """Reversed labels, each followed by a dot."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for every page; ``rules`` has ``(host, path, verdict)``.

    A rule fits if the url's host is its host or a subdomain of it and the url's path starts with its path; the
    longest rule (host and path together) wins, then the longer host, then block before allow. No fitting rule:
    ``rule`` null and the ``default`` verdict. Null or odd urls have an empty host and path and fit no rule; rules
    with a null part are ignored, repeated ones count once; repeated page rows are all judged. Extra columns are
    not read; an empty table gives an empty result.

    Bounds come from a bounded sample of (key, salt): a host with a third of all rows is spread over many buckets
    by its salt, and its rules go to each of them. The rules are a table, never sent whole to a task.
    """
    spark = pages.sparkSession
    url = F.col("url").cast("string")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    own = own.withColumn("key", key_of(F.col("host"))).withColumn("salt", F.xxhash64("page_id", "path"))
    n = own.count()
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // BUCKET_ROWS))
    some = own.select("key", "salt").sample(fraction=min(1.0, SAMPLE / max(n, 1)), seed=5).collect() if n else []  # about SAMPLE rows at any n
    some = sorted((r.key.encode(), r.salt) for r in some)
    bounds = sorted({some[i * len(some) // buckets] for i in range(1, buckets)}) if some else []
    keys = [k for k, _ in bounds]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [bisect_right(bounds, (k.encode(), s)) for k, s in zip(b.column(3).to_pylist(), b.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), b.column(3), pa.array([1] * len(at), pa.int32()), b.column(0), b.column(1), b.column(2), pa.nulls(len(at), pa.string())], names=NAMES)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A rule goes to each bucket that its interval [key, end) meets."""
        for b in batches:
            for host, path, verdict, key in zip(*(c.to_pylist() for c in b.columns)):
                k = key.encode()
                end = k[:-1] + b"/"  # the byte after the dot
                at = list(range(bisect_right(bounds, (k, -(1 << 63))), bisect_right(keys, end) + 1))
                m = len(at)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([key] * m), pa.array([0] * m, pa.int32()), pa.nulls(m, pa.int64()), pa.array([host] * m), pa.array([path] * m), pa.array([verdict] * m)], names=NAMES)

    table = rules.select(F.lower("host").alias("host"), "path", "verdict").dropna().distinct().withColumn("key", key_of(F.col("host")))
    events = own.mapInArrow(deal, DEALT).unionByName(table.mapInArrow(spread, DEALT))
    return events.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "key", "kind").mapInArrow(lambda x: sweep(x, default), OUT)


def sweep(batches: Iterator[pa.RecordBatch], default: str) -> Iterator[pa.RecordBatch]:
    """One pass over rules (kind 0) and urls (kind 1) in key order; the stack holds the rules active at the key."""
    stack: list[tuple[str, dict[str, tuple[str, str]], list[int]]] = []  # key, rule path -> (rule, verdict), path lengths, longest first
    at: int | None = None
    for b in batches:
        out: list[tuple] = []
        for bucket, key, kind, page, host, path, verdict in zip(*(c.to_pylist() for c in b.columns)):
            if bucket != at:
                at, stack = bucket, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                if not stack or stack[-1][0] != key:
                    stack.append((key, {}, []))
                _, paths, sizes = stack[-1]
                old = paths.get(path)
                if old is None or verdict == "block":
                    paths[path] = (host + path, verdict)
                if len(path) not in sizes:
                    sizes.append(len(path))
                    sizes.sort(reverse=True)
                continue
            best: tuple[int, str, str] | None = None
            for _, paths, sizes in reversed(stack):  # longer hosts first
                for size in sizes:
                    if size <= len(path) and (hit := paths.get(path[:size])):
                        if best is None or len(hit[0]) > best[0]:
                            best = (len(hit[0]), *hit)
                        break
            out.append((page, host, path, best[1] if best else None, best[2] if best else default))
        if out:
            c = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), *(pa.array(x, pa.string()) for x in c[1:])], names=["page_id", "host", "path", "rule", "verdict"])
