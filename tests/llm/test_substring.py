import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quillspan.llm.queries import op8_substrings
from quillspan.llm import substring
from quillspan.llm.substring import WINDOW, Words, _run_hashes, drop_repeated, locate, passages


def brute(rows):
    seen = Counter()
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for _, w in split:
        seen.update(tuple(w[i : i + WINDOW]) for i in range(len(w) - WINDOW + 1))
    out = []
    for d, w in split:
        stay = [True] * len(w)
        for i in range(len(w) - WINDOW + 1):
            if seen[tuple(w[i : i + WINDOW])] > 1:
                stay[i : i + WINDOW] = [False] * WINDOW
        kept = b" ".join(x for x, s in zip(w, stay) if s).decode()
        out.append((d, len(w), len(w) - sum(stay), kept))
    return sorted(out, key=str)


def test_run_hashes_depend_on_their_words_alone():
    w = np.random.default_rng(1).integers(0, 1 << 63, 200).astype(np.uint64)
    for size in (1, 2, 3, 8, 35):
        h = _run_hashes(w, size)
        assert len(h) == 200 - size + 1
        for i in (0, 5, len(h) - 1):
            assert _run_hashes(w[i : i + size], size)[0] == h[i]
        assert len(set(h.tolist())) == len(h)


def test_locate_finds_overlapping_passages():
    got = locate(np.array([*range(9), 20, 1, 2]), np.array([0, 9, 10, 12]), [(1, 2, 3), (3, 4), (7,), (4, 9)])
    assert [x.tolist() for x in got] == [[0, 0], [1, 7], [5, 8]]
    assert not len(locate(np.array([1]), np.array([0, 1]), [])[0])


def test_the_automaton_finds_what_no_passage_was_cut_from():
    """Windows that recur are cut to passages where they occur first; all other places are found by the automaton alone."""
    rnd = random.Random(8)
    word = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    core = word(50)
    texts = [core[:44] + word(9), word(9) + core[3:], word(5) + core[6:45], word(60)]
    words = Words(pa.array([" ".join(t) for t in texts]))
    start, stop = passages(words, np.zeros(4, np.int64), np.ones(4, np.int64))
    codes = words.codes.tolist()
    text, first, last = locate(words.codes, words.offsets, [tuple(codes[s:e]) for s, e in zip(start, stop)])
    marked = set(np.searchsorted(words.offsets, start, side="right") - 1)
    assert 2 not in marked and 2 in text  # the third text holds no window that is not in one before it
    got = {i: set() for i in range(4)}
    for i, s, e in zip(text, first, last):
        got[i] |= set(range(s, e))
    want = {i: {k for s in range(len(t) - WINDOW + 1) if sum(t[s : s + WINDOW] == u[j : j + WINDOW] for u in texts for j in range(len(u))) > 1 for k in range(s, s + WINDOW)} for i, t in enumerate(texts)}
    assert got == want


@pytest.mark.parametrize("hot", [20_000, 2])
def test_drop_repeated_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(substring, "HOT", hot)  # 2: most anchors have more segments than a task may hold
    rnd = random.Random(4)
    word = lambda n: " ".join(rnd.choice("abcdefgh") + str(rnd.randrange(50)) for _ in range(n))
    shared = [word(n) for n in (34, 35, 36, 60, 150)]
    rows = [(i, "\n".join([word(rnd.randrange(60)), rnd.choice(shared), word(rnd.randrange(60)), rnd.choice(shared)])) for i in range(150)]
    rows += [(i, word(80)) for i in range(200, 220)]
    rows += [(300, None), (301, ""), (302, " \t\n "), (303, "é " * 100), (304, "one two"), (305, rows[3][1]), (305, rows[3][1]), (None, rows[4][1]), (307, shared[4] + " " + shared[4])]
    clash = ["start", "stop", "anchor", "span", "seg", "first", "id", "ID_", "text_key", "ranges", "_ranges", "_id", "_key", "t", "n"]
    df = spark.createDataFrame([(d, t, 7, "k", *range(len(clash))) for d, t in rows], "doc_id long, text string, n_words int, kept string, " + ", ".join(f"`{c}` int" for c in clash))
    got = drop_repeated(df)
    assert got.columns == ["doc_id", "text", *clash, "n_words", "n_removed", "kept"]
    assert sorted(map(tuple, got.select("doc_id", "n_words", "n_removed", "kept").collect()), key=str) == brute(rows)
    assert drop_repeated(df.where("false")).count() == 0
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # a task meets segments again in later parts
    try:
        assert sorted(map(tuple, drop_repeated(df.coalesce(2)).select("doc_id", "n_words", "n_removed", "kept").collect()), key=str) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_query_equals_brute_force_on_a_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = [(d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in brute(rows)]
    assert sorted(map(tuple, op8_substrings(spark, sf).collect()), key=str) == want
