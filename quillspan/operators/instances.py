"""Labelled instances: every language line with every candidate of its document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.text import has_tag, id_form, normalize_name
from .features import document_facts, document_features, in_line, name_features, together, window_features
from .mentions import mentions as find_mentions
from .models import coverage, thresholds
from .spans import sessionize, span_bounds

LINE = ["doc_id", "span_ord", "lineno"]


def candidates_of(mentions: DataFrame) -> DataFrame:
    """``(doc_id, name, code, cand_ord)``: the pairs mentioned in a document, in order of their first mention."""
    return mentions.groupBy("doc_id", "name", "code").agg(F.min("ord").alias("cand_ord"))


def gold(l_lines: DataFrame, s: Settings = Settings()) -> DataFrame:
    name = normalize_name(F.col("lang_name")) if s.normalize_gold else F.lower("lang_name")
    return l_lines.select("doc_id", "span_id", *LINE[1:], F.coalesce(name, F.lit("???")).alias("gold_name"), F.coalesce("lang_code", F.lit("und")).alias("gold_code"))


def instances(lines: DataFrame, gazetteer: DataFrame, common: DataFrame, english: DataFrame, models: DataFrame | None = None, s: Settings = Settings(), found: DataFrame | None = None) -> DataFrame:
    """``(doc_id, span_id, span_ord, lineno, name, code, cand_ord, label, feats)``.

    ``models`` is (source, kind, name, code, n, gram) with sources ``field`` and ``web``; without it there are no model
    features. A candidate without any feature stays, with an empty array. Only families that are switched on are
    planned; document-wide features are computed once for a document and joined. ``found`` are the mentions if the
    caller has them already, kept (they are read by every family); otherwise they are found here.
    """
    if found is None:
        found = find_mentions(lines, gazetteer, s.single_mention, s.case_sensitive)
    facts = document_facts(lines, found)
    spans = sessionize(lines.where("span_id is not null or lineno is not null"))
    bounds = span_bounds(spans)
    tagged = lambda letter: spans.where(has_tag(F.col("tag"), letter, s.strict_tags))
    l_lines = tagged("L")
    candidates = candidates_of(found)
    per_doc = together([document_features(found, facts, s), name_features(candidates, common, english, s)])
    span_parts = [window_features(bounds, found, facts, s)]
    span_parts += [in_line(tagged(x), found, f"{x}-in-line", ["doc_id", "span_ord"]) for x in "GTM" if s.on(f"{x}-in-line")]
    line_parts = [in_line(l_lines, found, "L-in-line", ["doc_id", "lineno"])] if s.on("L-in-line") else []
    if models is not None:
        for feature, source, kind, n in (("L-LMw", "field", "word", s.word_n), ("L-LMc", "field", "character", s.character_n), ("L-LMm", "field", "morpheme", s.morpheme_n), ("L-CR-LMw", "web", "word", s.web_word_n), ("L-CR-LMc", "web", "character", s.web_char_n)):
            if s.on(feature):
                own = models.where((F.col("source") == source) & (F.col("kind") == kind) & (F.col("n") <= n))
                if source == "field" and s.code_only_models:
                    own = own.where("name is null").drop("name").join(candidates.select("name", "code").distinct(), "code")
                trim = n == 1 or (source == "field" and kind != "morpheme")
                text = F.lower("text") if s.fold_case else F.col("text")
                line_parts.append(thresholds(coverage(l_lines.select("doc_id", "lineno", text.alias("text")), candidates, own, kind, n, s.morpheme_delimiter, trim), feature))
    base = l_lines.select("doc_id", "span_id", "span_ord", "lineno").join(candidates, "doc_id")
    parts = [(per_doc, ["doc_id"]), (together(span_parts), ["doc_id", "span_ord"]), (together(line_parts) if line_parts else None, ["doc_id", "lineno"])]
    out = with_features(base, parts)
    truth = gold(l_lines, s).drop("span_id")
    out = out.join(truth, LINE)
    label = (F.col("name") == F.col("gold_name")) & (F.col("code") == F.col("gold_code"))
    return out.select("doc_id", "span_id", "span_ord", "lineno", "name", "code", "cand_ord", label.alias("label"), "feats")


def with_features(base: DataFrame, parts: list[tuple[DataFrame | None, list[str]]]) -> DataFrame:
    """``base`` with ``feats``: the features, in order and each once, of each row's (name, code).

    A part is ``(*keys, name, code, feature)`` with its keys (document, span or line); None is left out. Features are
    gathered for each key (some hundred names at most) before they meet the rows.
    """
    none = F.array().cast("array<string>")
    feats = none
    for i, (df, keys) in enumerate(parts):
        if df is not None:
            own = df.groupBy(*keys, "name", "code").agg(F.collect_set("feature").alias(f"f{i}"))
            base = base.join(own, [*keys, "name", "code"], "left")
            feats = F.array_union(feats, F.coalesce(f"f{i}", none))
    return base.withColumn("feats", F.array_sort(feats)).drop(*[f"f{i}" for i in range(len(parts))])


def vectors(rows: DataFrame) -> DataFrame:
    """``(doc_id, value)``: a line of text for each instance, its id and its features."""
    ident = F.concat_ws("-", "doc_id", "span_id", "lineno", id_form(F.col("name")), "code")
    return rows.select("doc_id", F.concat(ident, F.lit(": "), F.array_join("feats", ", ")).alias("value"))
