"""n-gram models of languages: building them and measuring how far they cover a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound, character_ngrams, morpheme_ngrams, word_ngrams, words

STEPS = [f"{i / 10:.1f}" for i in range(1, 11)]


def _grams(text: Column, kind: str, n: int, splitter: str) -> Column:
    """Grams of exactly n units as strings, units of words and morphemes with a blank between."""
    if kind == "character":
        return character_ngrams(text, n, n)
    runs = word_ngrams(text, n) if kind == "word" else morpheme_ngrams(text, n, splitter)
    return F.transform(runs, lambda g: F.array_join(g, " "))


def _counted(text: Column, kind: str, n: int, splitter: str) -> Column:
    """Grams for counting: words and morphemes in lower case and without padding."""
    if kind == "character":
        return character_ngrams(text, n, n)
    units = words(F.lower(text)) if kind == "word" else F.split(F.lower(text), splitter, -1)

    def of(u: Column) -> Column:
        starts = F.when(F.size(u) >= n, F.sequence(F.lit(1), F.size(u) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(u, i, n), " "))

    return bound(units, of)


def build_models(examples: DataFrame, nc: int = 3, nw: int = 2, splitter: str = r"[\s\-\=\+]+") -> DataFrame:
    """``(kind, code, name, n, gram, n_times)`` from ``(code, name, text)``, for each code and name and for each code.

    Characters 1..nc, words and morphemes 1..nw. Both groupings come from one scan (grouping sets); ``name`` is null
    in the rows of a code alone.
    """
    kinds = [("character", i) for i in range(1, nc + 1)] + [(k, i) for k in ("word", "morpheme") for i in range(1, nw + 1)]
    sets = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(i).alias("n"), _counted(F.col("text"), k, i, splitter).alias("grams")) for k, i in kinds])
    flat = examples.where("text is not null").select("code", "name", F.explode(sets).alias("s")).select("code", "name", "s.kind", "s.n", F.explode("s.grams").alias("gram")).where("gram <> ''")
    out = flat.groupingSets([["kind", "n", "gram", "code", "name"], ["kind", "n", "gram", "code"]], "kind", "n", "gram", "code", "name").agg(F.count("*").alias("n_times"), F.grouping("name").alias("alone"))
    return out.where("alone = 1 or name is not null").select("kind", "code", "name", "n", "gram", "n_times")


def model_sizes(models: DataFrame) -> DataFrame:
    """``(name, code, grams)``: how many different grams a pair's model has."""
    return models.groupBy("name", "code").agg(F.count_distinct("gram").alias("grams"))


def grams_of(text: Column, kind: str, n: int, splitter: str = r"[\s\-\=\+]+", trim: bool = True) -> Column:
    """The grams of a line, repeats included; ``trim`` drops the first and the last."""
    grams = _grams(text, kind, n, splitter)
    if trim:
        grams = bound(grams, lambda g: F.when(F.size(g) > 2, F.slice(g, F.lit(2), F.size(g) - 2)).otherwise(F.array().cast("array<string>")))
    return grams


def line_grams(lines: DataFrame, kind: str, n: int, splitter: str = r"[\s\-\=\+]+", trim: bool = True, text: str = "text") -> DataFrame:
    """The columns of ``lines`` but the text, and ``gram``: one row for each gram of each line, repeats included."""
    return lines.select(*[c for c in lines.columns if c != text], F.explode(grams_of(F.col(text), kind, n, splitter, trim)).alias("gram"))


def coverage(lines: DataFrame, candidates: DataFrame, models: DataFrame, kind: str, n: int, splitter: str = r"[\s\-\=\+]+", trim: bool = True) -> DataFrame:
    """``(doc_id, lineno, name, code, hits, total)``: how many of a line's grams a candidate's model has.

    ``lines`` is (doc_id, lineno, text), ``candidates`` (doc_id, name, code), ``models`` (name, code, gram) of one kind.
    Candidates without a model are left out, as are lines without grams. Grams are counted before they meet the
    candidates, and models are pruned to candidates (left semi) before they meet the grams.
    """
    grams = line_grams(lines.select("doc_id", "lineno", "text"), kind, n, splitter, trim).groupBy("doc_id", "lineno", "gram").agg(F.count("*").alias("k"))
    size = F.greatest(F.size(grams_of(F.col("text"), kind, n, splitter, trim)), F.lit(0))  # a row for each line, not for each gram
    totals = lines.select("doc_id", "lineno", size.alias("k")).groupBy("doc_id", "lineno").agg(F.sum("k").alias("total")).where("total > 0")
    own = models.select("name", "code", "gram").join(candidates.select("name", "code").distinct(), ["name", "code"], "left_semi").distinct()
    modelled = candidates.join(own.select("name", "code").distinct(), ["name", "code"], "left_semi")
    # grams meet the models by gram first: most grams of a line are in few models, and candidates only narrow that down
    hits = grams.join(own, "gram").join(modelled, ["doc_id", "name", "code"], "left_semi").groupBy("doc_id", "lineno", "name", "code").agg(F.sum("k").alias("hits"))
    return totals.join(modelled, "doc_id").join(hits, ["doc_id", "lineno", "name", "code"], "left").select("doc_id", "lineno", "name", "code", F.coalesce("hits", F.lit(0)).cast("long").alias("hits"), F.col("total").cast("long").alias("total"))


def thresholds(covered: DataFrame, feature: str) -> DataFrame:
    """``(doc_id, lineno, name, code, feature)``: ``feature>x`` for each tenth x that the share reaches, in integers."""
    steps = F.filter(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(s).alias("s")) for i, s in enumerate(STEPS, 1)]), lambda x: F.col("hits") * 10 >= x["i"] * F.col("total"))
    return covered.select("doc_id", "lineno", "name", "code", F.explode(steps).alias("x")).select("doc_id", "lineno", "name", "code", F.concat(F.lit(f"{feature}>"), F.col("x.s")).alias("feature"))
