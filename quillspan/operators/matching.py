"""Names of a gazetteer that fits in memory, found in paired lines: one pass over a line's tokens, without a row for each."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc

from ..functions.text import CORE, LETTER, _foldings

TRIMMED = " -"
#: What Java's ``(?U)\\s`` takes for white space.
TOKEN = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
PLAIN = re.compile("[A-Za-z0-9_]+")
#: ``\w`` of Python are the letters and digits of Unicode and the underscore.
CORES = re.compile(CORE.replace(LETTER, r"\w"))
#: Found names to a batch, and tokens whose words are kept; both only bound memory.
BATCH, KEPT = 1 << 15, 1 << 16


@cache
def _folded() -> dict[int, str | None]:
    one, to, gone, many = _foldings()
    return str.maketrans(dict(zip(one, to)) | dict.fromkeys(gone) | many)


def core(token: str) -> str:
    """As ``text.core``."""
    m = None if PLAIN.fullmatch(token) else CORES.search(token)
    return m.group() if m else token


def token_key(raw: str, case_sensitive: bool = False) -> str:
    """As ``mentions.token_key``."""
    folded = raw if raw.isascii() else raw.translate(_folded())
    return core(folded if case_sensitive else folded.lower())


def _texts(x: pa.Array) -> list[str | None]:
    """Bytes that are no UTF-8 stay, as surrogates."""
    return [b if b is None else b.decode("utf-8", "surrogateescape") for b in x.cast(pa.large_binary()).to_pylist()]


def _strings(texts: list[str], kind: pa.DataType) -> pa.Array:
    try:
        return pa.array(texts, kind)
    except UnicodeEncodeError:
        return pa.array([t.encode("utf-8", "surrogateescape") for t in texts], pa.large_binary()).cast(kind, safe=False)


def _packed(b: pa.RecordBatch, kind: pa.DataType, row: list, before: list, new: list, name: list, start: list, over: list, stop: list, text: list) -> pa.RecordBatch:
    """Found names of the rows of a batch, with the columns of those."""
    row, over = pa.array(row, pa.int32()), pa.array(over, pa.bool_())
    own = b.column("lineno").take(row)
    end = pc.if_else(over, b.column("lineno2").take(row), own)
    cols = [b.column("doc_id").take(row), pa.array(before, pa.int32()), pa.array(new, pa.bool_()), own, pa.array(start, pa.int32()), end, pa.array(stop, pa.int32()), _strings(name, kind), _strings(text, kind)]
    return pa.RecordBatch.from_arrays(cols, ["doc_id", "before", "new", "startline", "startcol", "endline", "endcol", "name", "text"])


def finder(names: dict[str, int], single: bool, case_sensitive: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For batches of (doc_id, lineno, lineno2, line1, line2) in order of document and line: the names that are found.

    ``names`` has the number of codes of each name. Rows are (doc_id, before, new, startline, startcol, endline, endcol,
    name, text) in order, with ``before`` the codes of the document's names so far; ``new``: its first of the document.
    """
    vocabulary = {w for name in names for w in name.split(" ")}
    longest = max((name.count(" ") + 1 for name in names), default=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple[str, int, int] | None] = {}

        def look(raw: str) -> tuple[str, int, int] | None:
            """The word that a token stands for, and where its core begins and ends within it."""
            key = token_key(raw, case_sensitive)
            word = key if key in vocabulary else key.replace("-", "") if "-" in key else None
            if word not in vocabulary:
                hit = None
            else:
                own = core(raw)
                at = raw.index(own)
                hit = (word, at, at + len(own))
            if len(memo) >= KEPT:
                memo.clear()
            memo[raw] = hit
            return hit

        def runs(joined: str, seam: int) -> list[list[tuple[str, int, int]]]:
            """Words that stand together, with start and stop; as far as a name may reach that begins before the seam, all if single."""
            out, words, beyond = [], [], 0
            for m in TOKEN.finditer(joined):
                raw = m.group()
                hit = memo[raw] if raw in memo else look(raw)
                if hit:
                    if not words:
                        out.append(words)
                    at = m.start()
                    words.append((hit[0], at + hit[1], at + hit[2]))
                elif words:
                    words = []
                if not single and m.end() > seam and m.start() >= seam:
                    beyond += 1
                    if beyond >= longest:
                        break
            return out

        def spans(words: list[tuple[str, int, int]], seam: int) -> list[tuple[str, int, int]]:
            """Parts of a run that are names and begin before the seam; only the longest of the run if single."""
            out, most, size = [], 0, len(words)
            for i, it in enumerate(words):
                name, start, _ = it
                if start >= seam and not single:
                    break
                if name in names and not most:
                    out.append(it)
                    most = 1 if single else 0
                for n in range(2, min(longest, size - i) + 1):
                    word, _, stop = words[i + n - 1]
                    name = f"{name} {word}"
                    if name in names and n > most:
                        if single:
                            out, most = [], n
                        out.append((name, start, stop))
            return out

        doc, before, seen = None, 0, set()
        for b in batches:
            kind, out = b.column("line1").type, tuple([] for _ in range(8))
            put_row, put_before, put_new, put_name, put_start, put_over, put_stop, put_text = (x.append for x in out)
            for i, (of, line1, line2) in enumerate(zip(b.column("doc_id").to_pylist(), _texts(b.column("line1")), _texts(b.column("line2")))):
                if of != doc:
                    doc, before, seen = of, 0, set()
                end1 = line1.rstrip(TRIMMED)
                seam = len(end1)
                if not seam:
                    continue
                lead, added, bare2 = 0, 0, ""
                if line2 is None:
                    joined = end1
                else:
                    bare2 = line2.lstrip(TRIMMED)
                    lead = len(line2) - len(bare2)
                    if line1.endswith("-") or line2.startswith("-"):
                        joined = line1.rstrip(" ") + line2.lstrip(" ")
                    else:
                        joined, added = f"{end1} {bare2}", 1
                for words in runs(joined, seam):
                    for name, start, stop in spans(words, seam):
                        over = stop > seam
                        if not over:
                            text = joined[start:stop]
                        elif start < seam and line2:
                            # the text between start and stop, with what was cut off at the seam put back
                            text = joined[start:seam] + line1[seam:] + line2[:lead] + joined[len(joined) - len(bare2):stop]
                            stop += lead - len(line1) - added
                        else:
                            continue
                        put_row(i), put_before(before), put_new(name not in seen), put_name(name), put_start(start), put_over(over), put_stop(stop), put_text(text)
                        seen.add(name)
                        before += names[name]
                if len(out[0]) >= BATCH:
                    yield _packed(b, kind, *out)
                    for x in out:
                        x.clear()
            if out[0]:
                yield _packed(b, kind, *out)

    return run
