"""Features of candidate names: document-wide, in windows around spans, and in lines.

Every function returns long rows, one for each feature that holds. Mentions are ``(doc_id, startline, name, code)``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings

PAIR = ["doc_id", "name", "code"]
LESS = (5, 10, 15, 20, 40)
#: Lines to a bucket of the range join.
BUCKET = 512


def document_facts(lines: DataFrame, mentions: DataFrame) -> DataFrame:
    """``(doc_id, last_line, num_lines, num_names)``"""
    names = mentions.groupBy("doc_id").agg(F.count_distinct("name").alias("num_names"))
    return lines.groupBy("doc_id").agg(F.max("lineno").alias("last_line"), F.count("*").alias("num_lines")).join(names, "doc_id", "left").na.fill(0, ["num_names"])


def _explode(df: DataFrame, keys: list[str], made: list[tuple[str | Column, Column]]) -> DataFrame:
    """A row for each feature whose condition holds."""
    feats = F.array(*[F.when(cond, name if isinstance(name, Column) else F.lit(name)) for name, cond in made])
    return df.select(*keys, F.explode(F.filter(feats, lambda x: x.isNotNull())).alias("feature"))


def _with_less(df: DataFrame, keys: list[str]) -> DataFrame:
    """``feature&langs<i`` beside each feature, for each i above the document's number of names."""
    less = F.transform(F.filter(F.array(*[F.lit(i) for i in LESS]), lambda i: F.col("num_names") < i), lambda i: F.concat("feature", F.lit("&langs<"), i.cast("string")))
    return df.withColumn("feature", F.explode(F.concat(F.array("feature"), less))).select(*keys, "feature")


def document_features(mentions: DataFrame, facts: DataFrame, s: Settings = Settings()) -> DataFrame:
    """First lines, last lines, frequent and most frequent names, with their ``&langs<`` variants: one aggregation."""
    at = F.col("startline")
    seen = mentions.join(facts.select("doc_id", "last_line", "num_names"), "doc_id").where((at >= 0) | (at >= F.col("last_line") - s.window_size))
    whole = at.between(0, F.col("last_line"))
    agg = seen.groupBy(*PAIR).agg(
        F.max(at.between(0, s.window_size)).alias("first"), F.max(at.between(F.col("last_line") - s.window_size, F.col("last_line"))).alias("last"),
        F.sum(whole.cast("int")).alias("n"), F.first("num_names").alias("num_names"))
    most = F.max("n").over(Window.partitionBy("doc_id"))
    made = [("GL-first-lines", F.col("first")), ("GL-last-lines", F.col("last")), ("GL-frequent", F.col("n") >= s.article_frequent_threshold), ("GL-most-frequent", (F.col("n") == F.col("most")) & (F.col("n") > 0))]
    out = _explode(agg.withColumn("most", most), [*PAIR, "num_names"], [x for x in made if s.on(x[0])])
    return _with_less(out, PAIR)


def name_features(candidates: DataFrame, common: DataFrame, english: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Of the name alone: common code, several words, English, an English word, short, at most i letters.

    ``common`` is (name, code), ``english`` (word): reference tables, joined by equality.
    """
    size = F.length("name")
    c = candidates.select(*PAIR).join(common.select("name", "code", F.lit(True).alias("common")).distinct(), ["name", "code"], "left")
    c = c.join(english.select(F.col("word").alias("name"), F.lit(True).alias("word")).distinct(), "name", "left")
    made: list[tuple[str, Column]] = []
    if s.on("GL-most-frequent-code"):
        made.append(("GL-most-frequent-code", F.col("common")))
        if s.on("GL-multi-word-name"):
            made.append(("GL-multi-word-name", F.size(F.split("name", " ")) > 1))
    if s.on("GL-is-english"):
        made.append(("GL-is-english", (F.col("name") == "english") & (F.col("code") == "eng")))
    if s.on("GL-possible-english-word"):
        made.append(("GL-possible-english-word", F.col("word")))
    if s.on("GL-short-lang-name"):
        made += [("GL-short-lang-name", size <= s.short_name_size), *((f"GL-C-name<{i}", size <= i) for i in range(1, 10))]
    return _explode(c, PAIR, made)


def window_features(spans: DataFrame, mentions: DataFrame, facts: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``(doc_id, span_ord, name, code, feature)`` of windows before and after each span (doc_id, span_ord, top, bottom).

    One range join over the widest window and conditional aggregates in place of a join for each window. The join is
    on document and bucket of lines, so a long document is spread over tasks and meets only its neighbourhood.
    """
    keys = ["doc_id", "span_ord", "name", "code"]
    wide = max(s.wide_window_size, s.window_size, s.after_window_size)
    spread = spans.select("doc_id", "span_ord", "top", "bottom", F.explode(F.sequence(F.floor((F.col("top") - wide) / BUCKET), F.floor((F.col("bottom") + wide) / BUCKET))).alias("bucket"))
    placed = mentions.select("doc_id", "startline", "name", "code", F.floor(F.col("startline") / BUCKET).alias("bucket"))
    at, t, b = F.col("startline"), F.col("top"), F.col("bottom")
    met = spread.join(placed, ["doc_id", "bucket"]).where(at.between(t - wide, b + wide))
    many = lambda cond: F.sum(cond.cast("int"))
    before, after = at.between(t - s.window_size, t), at.between(b, b + s.after_window_size)
    agg = met.groupBy(*keys).agg(
        F.max(before).alias("prev"), F.max(at.between(t - s.close_window_size, t)).alias("close"), F.min(F.when(before, F.abs(t - at))).alias("d"), many(before).alias("n"),
        F.max(after).alias("next"), F.max(at.between(b, b + s.after_close_window_size)).alias("close2"), F.min(F.when(after, F.abs(b - at))).alias("d2"), many(after).alias("n2"),
        many(at.between(t - s.wide_window_size, t)).alias("w"), many(at.between(b, b + s.wide_window_size)).alias("w2"))
    span = Window.partitionBy("doc_id", "span_ord")
    agg = agg.withColumns({"least": F.min("d").over(span), "least2": F.min("d2").over(span)}).join(facts.select("doc_id", "num_names", "num_lines"), "doc_id")
    c, names, long = F.col, F.col("num_names") > s.wide_min_names, F.col("num_lines") > s.wide_min_lines
    f, f2 = s.frequent_threshold, s.after_frequent_threshold
    made = [
        ("W-prev", c("prev")), ("W-close", c("close")), ("W-closest", c("d") == c("least")), ("W-frequent", c("n") >= f),
        ("W-after", c("next")), ("W-close-after", c("close2")), ("W-closest-after", c("d2") == c("least2")), ("W-frequent-after", c("n2") >= f2),
    ]
    made = [x for x in made if s.on(x[0])]
    size = s.wide_window_size
    for base, count, least in (("W-frequent", "w", f), ("W-frequent-after", "w2", f2)):
        if s.on(base):
            tail = base.removeprefix("W-")
            made += [(f"W={size}&langs>{s.wide_min_names}-{tail}", names & (c(count) >= least)), (f"W={size}&lines>{s.wide_min_lines}-{tail}", long & (c(count) >= least))]
    return _explode(agg, keys, made)


def in_line(lines: DataFrame, mentions: DataFrame, feature: str, keys: list[str]) -> DataFrame:
    """``(*keys, name, code, feature)``: a mention starts on a line; ``keys`` are the line's own or its span's."""
    m = mentions.select("doc_id", F.col("startline").alias("lineno"), "name", "code")
    return lines.join(m, ["doc_id", "lineno"]).select(*keys, "name", "code", F.lit(feature).alias("feature")).distinct()


def together(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)
