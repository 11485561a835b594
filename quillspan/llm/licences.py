"""Licence scans by conditional compression.

Blocks around licence wording are compressed alone and again with each template as a raw zstandard dictionary. The
relative reduction in size ranks the templates; the best one is confirmed by its exact wording differences, and only
a block that has nearly all of a template's words, in order, counts as carrying that licence. Before that, the lines
around a block (twice the longest template) are searched for every template most of whose words they have, so that
wrapped texts and several licences in one place are found.
"""

from __future__ import annotations

import difflib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Notices and short texts of common public licences: (licence, wording).
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("all-rights-reserved", "All rights reserved."),
]

CUES = re.compile(r"licen[sc]|copyright|permission|redistribut|unencumbered|all rights reserved|public domain|creative commons")
QUICK = ("licen", "copyright", "permission", "redistribut", "unencumbered", "rights reserved", "public domain", "creative commons")
WORD = re.compile(r"[\w.+-]*\w|\S")
OUT = "doc_id long, start long, length long, licence string, size_alone long, size_given long, reduction double, n_same long, missing array<string>, added array<string>, confirmed boolean"


def blocks(text: str, reach: int = 400) -> list[tuple[int, int]]:
    """Candidate blocks [start, stop): lines with licence wording, joined if next to one another.

    Of a line longer than twice the reach only what lies within reach of its cues, cut at spaces, is a block.
    """
    if not any(q in (low := text.lower()) for q in QUICK) or len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text) if len(low) != len(text) else low
        if not any(q in low for q in QUICK):
            return []
    out: list[tuple[int, int]] = []
    for m in CUES.finditer(low):
        s, e = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.end())
        e = len(text) if e < 0 else e
        if e - s > 2 * reach:
            if m.start() - reach > s:
                s = text.rfind(" ", s, m.start() - reach) + 1 or m.start() - reach
            if m.end() + reach < e:
                at = text.find(" ", m.end() + reach, e)
                e = at if at >= 0 else e
        if out and s <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


class Scanner:
    def __init__(self, templates: list[tuple[str, str]]) -> None:
        self.templates = [(name, WORD.findall(t.lower()), zstandard.ZstdCompressor(level=19, dict_data=zstandard.ZstdCompressionDict(t.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT))) for name, t in templates]
        self.alone = zstandard.ZstdCompressor(level=19)
        self.counts = [Counter(wording) for _, wording, _ in self.templates]
        self.reach = 2 * max(len(t) for _, t in templates)

    def scan(self, text: str) -> list[tuple]:
        """``(start, length, *best)`` of each licence found, and of each block in which none is, by start."""
        cores = blocks(text)
        areas: list[list[int]] = []
        for s, e in cores:
            s, e = max(0, s - self.reach), min(len(text), e + self.reach)
            if areas and s <= areas[-1][1]:
                areas[-1][1] = e
            else:
                areas.append([s, e])
        rows = [r for s, e in areas for r in self.confirmed(text, s, e)]
        spans = [(r[0], r[0] + r[1]) for r in rows]
        for s, e in cores:
            cut = sorted((a, b) for a, b in spans if a < e and b > s)
            for a, b in zip([s, *(b for _, b in cut)], [*(a for a, _ in cut), e]):
                if text[a:b].strip() and (not cut or CUES.search(text[a:b].lower())):
                    row = (a, b - a, *self.best(text[a:b]))
                    if not cut or row[-1]:
                        rows.append(row)
        return sorted(rows, key=lambda r: r[:2])

    def confirmed(self, text: str, start: int, stop: int, share: float = 0.8) -> list[tuple]:
        """Rows of all templates that the area has, each time the one with the fewest differences; its words are cut out then."""
        found = [(m.group().lower(), start + m.start(), start + m.end()) for m in WORD.finditer(text[start:stop])]
        words = [w for w, _, _ in found]
        rows = []
        have = Counter(words)
        left = [i for i, c in enumerate(self.counts) if (c & have).total() >= share * c.total()]
        while left:
            hits = []
            for i in list(left):
                if (hit := located(self.templates[i][1], words, share)) is None:
                    left.remove(i)  # cutting words out makes no new match
                else:
                    hits.append((len(hit[3]) - hit[2], len(hit[3]) + len(hit[4]), i, hit))
            if not hits:
                break
            _, _, i, (a, b, same, missing, added) = min(hits)
            s, e = found[a][1], found[b - 1][2]
            data = text[s:e].lower().encode()
            alone, given = len(self.alone.compress(data)), len(self.templates[i][2].compress(data))
            rows.append((s, e - s, self.templates[i][0], alone, given, (alone - given) / alone, same, missing, added, True))
            words[a:b] = ["\0"] * (b - a)
        return rows

    def best(self, block: str, share: float = 0.8) -> tuple:
        """(licence, size alone, size given, reduction, same words, missing, added, confirmed) of the winner.

        Templates are ranked by the reduction (ties: the one listed first); those tied within 10 % of the best are
        compared word by word, all of them, and the one with the fewest differences wins.
        """
        data = block.lower().encode()
        alone = len(self.alone.compress(data))
        sizes = [len(c.compress(data)) for _, _, c in self.templates]
        ranked = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        words = WORD.findall(block.lower())
        found = None
        for i in [i for i in ranked if alone - sizes[i] >= 0.9 * (alone - sizes[ranked[0]])]:
            name, wording, _ = self.templates[i]
            same, missing, added = difference(wording, words)
            row = (len(missing) - same, len(missing) + len(added), (name, alone, sizes[i], (alone - sizes[i]) / alone, same, missing, added, same >= share * len(wording) and not decisive(missing, added)))
            if found is None or row[:2] < found[:2]:
                found = row
        return found[2]


def located(wording: list[str], words: list[str], share: float) -> tuple | None:
    """``(first, stop, same, missing, added)`` of a confirmed match of the wording in a longer run of words, or None.

    A match has at most half as many words again as the wording; each long enough run that both share is tried.
    """
    n, spare = len(wording), len(wording) // 2 + 1
    tried = list(words)
    while True:
        m = difflib.SequenceMatcher(None, wording, tried, autojunk=False).find_longest_match()
        if m.size < max(min(2, n - 2), n // 25, 1):
            return None
        lo, hi = max(0, m.b - m.a - spare), min(len(words), m.b + n - m.a + spare)
        inner = [x for x in difflib.SequenceMatcher(None, wording, words[lo:hi], autojunk=False).get_matching_blocks() if x.size]
        for trim in (True, False):
            run = list(inner)
            while trim and len(run) > 1 and run[1].b - run[0].b - run[0].size > run[0].size:
                run.pop(0)
            while trim and len(run) > 1 and run[-1].b - run[-2].b - run[-2].size > run[-1].size:
                run.pop()
            first, stop = lo + run[0].b, lo + run[-1].b + run[-1].size
            same, missing, added = difference(wording, words[first:stop])
            if same >= share * n and "\0" not in added and len(added) <= spare and not decisive(missing, added):
                return first, stop, same, missing, added
        tried[m.b : m.b + m.size] = ["\0"] * m.size


def difference(wording: list[str], words: list[str]) -> tuple[int, list[str], list[str]]:
    """Words of the template that the block has in order, those it lacks, and those it has between them."""
    matches = [m for m in difflib.SequenceMatcher(None, wording, words, autojunk=False).get_matching_blocks() if m.size]
    same = sum(m.size for m in matches)
    missing, added, at, to = [], [], 0, matches[0].b if matches else 0
    for m in matches:
        missing += wording[at : m.a]
        added += words[to : m.b]
        at, to = m.a + m.size, m.b + m.size
    return same, missing + wording[at:], added


def decisive(missing: list[str], added: list[str]) -> bool:
    """Differences that name another licence or version: numbers, short variants, family names."""
    names = {"mit", "apache", "gnu", "lesser", "affero", "general", "mozilla", "bsd", "by", "by-nc", "by-sa", "by-nd", "by-nc-sa", "by-nc-nd", "noncommercial", "not", "cc", "cc0"}
    return any(w in names or re.fullmatch(r"v?\d+(\.\d+)*", w) for w in [*missing, *added])


def scan_licences(docs: DataFrame, templates: list[tuple[str, str]] | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row for each licence confirmed in a document, and for each candidate block without one its best template.

    Columns: ``doc_id, start, length`` (code points), ``licence, size_alone, size_given, reduction`` (relative),
    ``n_same``, ``missing`` and ``added`` words, ``confirmed``. Whole texts are scanned in one pass without a shuffle;
    documents without licence wording, null and empty texts give no row; repeated rows give repeated results; extra
    columns are not read. The templates are a parameter; they go to each task (a bounded list of short texts).
    """
    chosen = templates or TEMPLATES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(chosen)
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("licence", pa.string()), ("size_alone", pa.int64()), ("size_given", pa.int64()), ("reduction", pa.float64()), ("n_same", pa.int64()), ("missing", pa.list_(pa.string())), ("added", pa.list_(pa.string())), ("confirmed", pa.bool_())])
        for b in batches:
            rows = []
            for doc, t in zip(b.column(0).to_pylist(), b.column(1)):
                text = t.as_py() or ""
                rows += [(doc, *r) for r in scanner.scan(text)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t")).mapInArrow(run, OUT)
