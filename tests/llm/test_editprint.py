import hashlib

import numpy as np
import pytest

from quillspan.llm import editprint
from quillspan.llm.editprint import EMPTY, edited, fingerprint_with_edits, likeness, walk


def brute(rows):
    """Next documents and edited texts by a plain sort."""
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(2**62)), r[1] or ""))
    out = []
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        e = edited(t, nxt)
        fp = walk([t, e, nxt])
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), fp[0].tobytes().hex(), fp[1].tobytes().hex(), float(likeness(fp[0], fp[1])), float(likeness(fp[0], fp[2]))))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [10_000_000, 500])
def test_rows_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(editprint, "BLOCK_CHARS", block)
    rows = [(i * 3, "".join(chr(97 + (i * k) % 23) for k in range(i % 90))) for i in range(150)] + [(7, None), (8, ""), (9, "😀é" * 50), (10, "x" * 30_000), (11, "ab"), (600, "same"), (601, "same"), (601, "same"), (None, "no id")]
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, k int, tail int")
    got = fingerprint_with_edits(df)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
    assert fingerprint_with_edits(df.where("false")).count() == 0


def test_a_sole_document_follows_itself(spark):
    df = spark.createDataFrame([(1, "abcdefghi")], "doc_id long, text string")
    r = fingerprint_with_edits(df).first()
    assert r.edited_sha256 == hashlib.sha256(b"abcdefabc").hexdigest() and r.near_next == 1.0


def test_likeness_follows_edits():
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("abcdefgh ,.")) for _ in range(800)) for _ in range(60)]
    fp = walk(texts)
    near = [np.mean([float(likeness(a, b)) for a, b in zip(fp, walk([t[: 400 - k] + "z" * k + t[400:] for t in texts]))]) for k in (0, 10, 100, 400)]
    assert near[0] == 1.0 and near[0] > near[1] > near[2] > near[3]
    assert near[1] > 0.8 > 0.3 > np.mean(likeness(fp, np.roll(fp, 1, axis=0)))
    inserted = np.mean([float(likeness(a, b)) for a, b in zip(fp, walk([t[:300] + "q" + t[300:] for t in texts]))])
    assert inserted > 0.7
    assert walk([""])[0].tobytes().hex() == EMPTY and (walk(texts[:3])[1] == walk([texts[1]])[0]).all()
