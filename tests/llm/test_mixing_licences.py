import hashlib
import math
import re
import textwrap

import pytest

from quillspan.llm.licences import TEMPLATES, WORD, Scanner, blocks, difference, scan_licences
from quillspan.llm.mixing import mix_sources


def count(seed, key, rate):
    parts = max(1, math.ceil(rate / 500))
    mean, n = rate / parts, 0
    for i in range(1, parts + 1):
        u = int(hashlib.md5(f"{seed}:{key}:{i}".encode()).hexdigest()[:13], 16) / 2**52
        k, p = 0, math.exp(-mean)
        c = p
        while c <= u:
            k += 1
            p *= mean / k
            c += p
        n += k
    return n


@pytest.mark.parametrize("weights,epochs", [({}, 1.0), ({"a": 5.0, "b": 0.0}, 2.0), ({"tiny": 5000.0}, 1.0)])
def test_counts_equal_brute_force(spark, weights, epochs):
    rows = [(i, "x" * (i % 40), "a") for i in range(200)] + [(i, "yy" * 10, "b") for i in range(200, 260)] + [(300, "z", "tiny"), (301, None, None), (302, "", "void"), (303, "q", None), (303, "q", None), (None, "n", "a")]
    sizes, names = {}, {}
    for _, t, s in rows:
        sizes[s or ""] = sizes.get(s or "", 0) + len(t or "")
    names = {s: weights.get(s, 1.0) for s, n in sizes.items() if n}
    total, all_w = sum(sizes.values()), sum(names.values())
    rate = {s: epochs * names[s] / all_w * total / n if n else epochs for s, n in sizes.items()}
    want = sorted(((d, t, s, c) for d, t, s in rows for c in range(count("mix", "null" if d is None else d, rate[s or ""]))), key=str)
    own = ["mixed", "parts", "cdf", "rate", "key", "n", "doc", "all_size", "_cdf", "a.b"]  # names used inside, and a dot
    df = spark.createDataFrame([(*r, 9, *("m" * len(own))) for r in rows], ", ".join(["doc_id long, text string, source string, copy int", *(f"`{c}` string" for c in own)]))
    got = mix_sources(df, weights, epochs=epochs)
    assert got.columns == ["doc_id", "text", "source", *own, "copy", "order_key"]
    assert sorted(((r.doc_id, r.text, r.source, r.copy) for r in got.collect()), key=str) == want
    assert mix_sources(df.where("false"), weights).count() == 0


def test_shares_come_to_the_targets(spark):
    rows = [(i, "x" * 50, "big") for i in range(6000)] + [(10_000 + i, "x" * 50, "small") for i in range(2000)]
    got = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), {"big": 1.0, "small": 3.0}).groupBy("source").count()
    n = {r["source"]: r["count"] for r in got.collect()}
    assert abs(n["small"] / (n["small"] + n["big"]) - 0.75) < 0.02 and abs(n["small"] + n["big"] - 8000) < 400


def test_scan_finds_planted_licences(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    rows = [(1, "text\nReleased under the MIT License.\nmore"), (2, "LICENSED UNDER CC BY-NC 4.0."), (3, "Licensed under CC BY 4.0."), (4, "we gave permission to nobody at all"), (5, None), (6, ""), (7, "no such words"), (8, "word " * 9000 + mit + " word" * 9000),
            (9, "This work is licensed under the GNU General Public License, version 2."), (10, "a licence here\n\n\nReleased under the MIT License."), (1, "text\nReleased under the MIT License.\nmore")]
    got = scan_licences(spark.createDataFrame([(*r, "y") for r in rows], "doc_id long, text string, licence string")).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.licence, r.confirmed))
    assert by[1] == [("MIT", True)] * 2 and by[2] == [("CC-BY-NC-4.0", True)] and by[3] == [("CC-BY-4.0", True)]
    assert not by[4][0][1] and by[8][0] == ("MIT", True) and not by[9][0][1]  # another version is another licence
    assert ("MIT", True) in by[10] and not {5, 6, 7} & set(by)
    r = next(r for r in got if r.doc_id == 1)
    assert (r.start, r.length, r.missing, r.added) == (5, 31, [], []) and r.size_given < r.size_alone
    assert scan_licences(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_ranking_equals_compressing_all_pairs():
    import zstandard

    texts = [("a", "alpha beta gamma delta epsilon zeta"), ("b", "one two three four five six seven")]
    got = Scanner(texts).best("one two three four nine six seven")
    data = b"one two three four nine six seven"
    sizes = [len(zstandard.ZstdCompressor(level=19, dict_data=zstandard.ZstdCompressionDict(t.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)).compress(data)) for _, t in texts]
    assert got[0] == "b" and got[2] == min(sizes) and got[4:7] == (6, ["five"], ["nine"])
    assert difference(["x"], ["y"]) == (0, ["x"], []) and blocks("ıİ" * 5 + "\nLicensed") == [(11, 19)]


def confirmed(text):
    return [(r[2], text[r[0] : r[0] + r[1]]) for r in Scanner(TEMPLATES).scan(text) if r[-1]]


@pytest.mark.parametrize("name,wording", [(n, t) for n, t in TEMPLATES if len(t) > 200])
@pytest.mark.parametrize("prefix", ["", " * ", "# "])
def test_wrapped_texts_are_found(name, wording, prefix):
    lines = textwrap.wrap(wording, 72)
    text = "some prose of a page\n" * 20 + "\n".join(prefix + x for x in lines) + "\n" + "more prose of a page\n" * 20
    got = confirmed(text)
    assert [n for n, _ in got] == [name]
    assert WORD.findall(got[0][1].replace("\n" + prefix, "\n")) == WORD.findall(wording)
    parts = f"\n{prefix}\n{prefix}".join(lines)  # blank lines between
    assert [n for n, _ in confirmed(parts)] == [name]


@pytest.mark.parametrize("between", ["\n", " ", "\n\n"])
def test_every_licence_of_a_block_is_found(between):
    text = between.join(["Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "Licensed under CC BY 4.0.", "Released under the MIT License."])
    assert [n for n, _ in confirmed(text)] == ["Apache-2.0", "MIT", "CC-BY-4.0", "MIT"]


def test_all_tied_templates_are_compared():
    names = "ant bee cat dog elk fox gnu hen ibis jay koi lynx".split()
    family = [(x, f"This licence of the {x} family lets everyone copy the work and change the work") for x in names]
    for x in names:
        text = f"This licence of the {x} family lets everyone copy the work and change the work"
        assert [r[2] for r in Scanner(family).scan(text)] == [x] and Scanner(family).best(text)[0] == x


def test_every_exact_wording_in_a_table_is_confirmed_where_it_stands(spark):
    """All documents of a table are searched for each template's words, one after another, without the scanner."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = {}
    for r in scan_licences(docs).where("confirmed").collect():
        found.setdefault(r.doc_id, []).append((r.start, r.start + r.length, r.licence))
    planted = 0
    for r in docs.select("doc_id", "text").collect():
        low = (r.text or "").lower()
        spots = [(m.start(), m.end(), name) for name, t in TEMPLATES for m in re.finditer(re.escape(t.lower()), low)]
        spots = [s for s in spots if not any(o != s and o[0] <= s[0] and s[1] <= o[1] for o in spots)]
        planted += len(spots)
        for start, stop, name in spots:
            assert any(a < stop and b > start and licence == name for a, b, licence in found.get(r.doc_id, [])), (r.doc_id, name)
        for a, b, licence in found.get(r.doc_id, []):  # what is confirmed names its licence in words that stand there
            assert low[a:b].strip() and any(name == licence for name, _ in TEMPLATES)
    assert planted > 20
