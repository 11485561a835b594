"""Text functions as column expressions: all of them run in the JVM."""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTER = r"[\p{L}\p{N}_]"
#: A token's core: letters and digits, joined by - ' or /, and the marks with which names may begin.
CORE = rf"['ǂ!/=]*{LETTER}+(?:[-'/]+{LETTER}+)*"
SPACE = r"(?U)\s+"


@cache
def _foldings() -> tuple[str, str, str, dict[str, str]]:
    """Characters that fold to one character, their foldings, those that vanish, and those that become several.

    Hangul syllables are left composed: they would fold alike on both sides of every comparison.
    """
    one, to, gone, many = [], [], [], {}
    for cp in range(0x80, sys.maxunicode + 1):
        c = chr(cp)
        if 0xAC00 <= cp <= 0xD7A3 or 0xD800 <= cp <= 0xDFFF:
            continue
        d = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if d == c:
            continue
        if not d:
            gone.append(c)
        elif len(d) == 1:
            one.append(c)
            to.append(d)
        else:
            many[c] = d
    return "".join(one), "".join(to), "".join(gone), many


def _class(chars: list[int]) -> str:
    """A regex class of code points as ranges."""
    out, start, last = [], None, None
    for c in [*sorted(chars), None]:
        if start is not None and c != last + 1:
            out.append(f"\\x{{{start:x}}}-\\x{{{last:x}}}")
            start = None
        if start is None:
            start = c
        last = c
    return f"[{''.join(out)}]"


@cache
def _near() -> tuple[str, str, str]:
    """For texts of letters below U+0250 only: a class of those that need no more than the two strings of foldings."""
    one, to, gone, many = _foldings()
    small = [(c, d) for c, d in zip(one, to) if ord(c) < 0x250]
    return _class([c for c in range(0x250) if chr(c) not in many and chr(c) not in gone]), "".join(c for c, _ in small), "".join(d for _, d in small)


def strip_accents(x: Column) -> Column:
    """Compatibility decomposition without its combining marks. ASCII passes untouched; Latin letters take a short table."""
    one, to, gone, many = _foldings()
    near, near_one, near_to = _near()
    table = F.from_json(F.lit(json.dumps(many)), "map<string,string>")  # folded to a constant by the optimizer
    several = F.array_join(F.transform(F.split(x, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    any_ = F.translate(F.when(x.rlike(_class([ord(c) for c in many])), several).otherwise(x), one + gone, to)
    return F.when(~x.rlike(r"[^\x00-\x7F]"), x).when(x.rlike(f"^{near}*$"), F.translate(x, near_one, near_to)).otherwise(any_)


def normalize_name(x: Column) -> Column:
    """A language name without accents and parentheses, spaces collapsed, in lower case."""
    x = F.regexp_replace(strip_accents(x), r" \([^)]*\)", "")
    return F.lower(F.trim(F.regexp_replace(x, SPACE, " ")))


def core(token: Column) -> Column:
    """The token without punctuation around it; a token without letters or digits stays as it is."""
    found = F.nullif(F.regexp_extract(token, CORE, 0), F.lit(""))
    return F.when(token.rlike("^[A-Za-z0-9_]+$"), token).otherwise(F.coalesce(found, token))


def words(text: Column) -> Column:
    """Tokens between (Unicode) white space."""
    return F.filter(F.split(text, SPACE), lambda t: t != "")


def tokens(text: Column) -> Column:
    """array<struct<raw, start, stop>>: tokens with the place of their cores, from 0, end exclusive."""
    pieces = F.regexp_extract_all(text, F.lit(r"(?U)\s*\S+"), F.lit(0))
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<raw: string, start: int, stop: int>>)").alias("out"))

    def step(s: Column, p: Column) -> Column:
        raw = F.regexp_extract(p, r"(?U)\S+", 0)
        start = s["at"] + F.length(p) - F.length(raw) + F.position(core(raw), raw) - 1
        return F.struct((s["at"] + F.length(p)).alias("at"), F.concat(s["out"], F.array(F.struct(raw.alias("raw"), start.alias("start"), (start + F.length(core(raw))).alias("stop")))).alias("out"))

    return F.aggregate(pieces, zero, step, lambda s: s["out"])


def has_tag(tag: Column, letter: str, strict: bool = False) -> Column:
    """A tag holds the letter anywhere (``M+LN`` counts for L); if strict, its part before + must be the letter."""
    return F.coalesce(F.regexp_extract(tag, r"^\*?([A-Z]+)", 1) == letter if strict else tag.contains(letter), F.lit(False))


def id_form(name: Column) -> Column:
    return F.replace(name, F.lit(" "), F.lit("_"))


def character_ngrams(text: Column, low: int, high: int, lhs: str = "<", rhs: str = ">") -> Column:
    """Grams of each padded word: from each start that fits the longest gram (one at least), all lengths low..high."""
    def of(w: Column) -> Column:
        p = F.concat(F.lit(lhs), w, F.lit(rhs))
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(p) - (high - 1)))
        return F.flatten(F.transform(starts, lambda i: F.array(*[F.substring(p, i, F.lit(n)) for n in range(low, high + 1)])))

    return F.flatten(F.transform(words(text), of))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with the value worked out once a row: within a lambda an expression is worked out for each element."""
    return F.transform(F.array(value), body)[0]


def _runs(units: Column, n: int) -> Column:
    def of(u: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(u) - (n - 1)))
        return F.transform(starts, lambda i: F.slice(u, i, n))

    return bound(units, of)


def word_ngrams(text: Column, n: int, lhs: str = "\\n", rhs: str = "\\n") -> Column:
    """Runs of n words, padded with a literal backslash and n on either side; arrays of words."""
    return _runs(F.concat(F.array(F.lit(lhs)), words(text), F.array(F.lit(rhs))), n)


def morpheme_ngrams(text: Column, n: int, splitter: str = r"[\s\-\=\+]+", lhs: str = "", rhs: str = "") -> Column:
    """Runs of n morphemes, empty ones too, padded with empty strings; arrays of morphemes."""
    return _runs(F.concat(F.array(F.lit(lhs)), F.split(text, splitter, -1), F.array(F.lit(rhs))), n)


def contiguous(items: Column, longest: int) -> Column:
    """All contiguous sublists of up to ``longest`` items, as structs (pos, n, items), pos from 1."""
    def of(items: Column) -> Column:
        by_start = F.transform(F.sequence(F.lit(1), F.size(items)), lambda p: F.transform(
            F.sequence(F.lit(1), F.least(F.lit(longest), F.size(items) - p + 1)), lambda n: F.struct(p.alias("pos"), n.alias("n"), F.slice(items, p, n).alias("items"))))
        return F.when(F.size(items) > 0, F.flatten(by_start)).otherwise(F.expr("array()").cast("array<struct<pos:int,n:int,items:array<string>>>"))

    return bound(items, of)
