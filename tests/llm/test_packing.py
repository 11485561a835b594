import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspan.llm.packing import Encoder, fullest, pack, places, plan
from quillspan.llm.queries import op1_packing, tokenizer_file


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 5), min_size=1, max_size=6), st.integers(30, 60))
def test_fullest_is_the_best_subset_sum(counts, capacity):
    best = {0}
    for k, n in counts.items():
        best = {s + k * i for s in best for i in range(n + 1) if s + k * i <= capacity}
    got = fullest(counts, capacity)
    assert sum(k * n for k, n in got) == max(best)
    assert all(n <= counts[k] for k, n in got)


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.integers(1, 99), st.integers(1, 500), max_size=20))
def test_plan_and_places_use_every_piece_once_without_gaps(counts):
    windows = plan(counts, 100)
    where = places(windows, 0)
    fills = {}
    for k, n in counts.items():
        starts, entries = where[k]
        for rank in range(n):
            i = max(x for x in range(len(starts)) if starts[x] <= rank)
            many, first, offset = entries[i]
            w, slot = divmod(rank - starts[i], many)
            fills.setdefault(first + w, []).append((offset + slot * k, k))
    assert sorted(fills) == list(range(sum(t for t, _ in windows)))
    for xs in fills.values():
        end = 0
        for offset, k in sorted(xs):
            assert offset == end
            end += k
        assert end <= 100


def own_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file())


TOKENIZER = own_tokenizer()
ENCODER = Encoder(TOKENIZER)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40), st.text(alphabet="aSst'\u2019 \n\t\x0b\x0c\r\x1c\x85\xa0\u2003\u0301\u0130\u03a3\u0345e9<|endoftext>\u1100\u1161", max_size=60)), max_size=4))
def test_ids_by_words_are_the_ids_of_the_whole_text(texts):
    got = [x.tolist() for x in ENCODER(pa.array(texts, pa.string()))]
    assert got == [TOKENIZER.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]


def test_every_letter_with_marks_after_it():
    import unicodedata

    letters = [chr(c) for c in range(0x20, 0x11000) if unicodedata.category(chr(c))[0] in "LMN"]
    texts = [x for c in letters for x in (f"{c}{{ a{c}.) b", f"A{c}\u0301! {c}'s")] + ["İ{", "x<|endoftext|>y. <|ENDOFTEXT|> <|startoftext|>!", "|> a|> <|endoftext", "ﬁ! ŉ? ǅ. ς, Σ."]
    got = [x.tolist() for x in Encoder(TOKENIZER)(pa.array(texts, pa.string()))]
    want = [[*e.ids, 2] for e in TOKENIZER.encode_batch(texts, add_special_tokens=False)]
    assert [t for t, g, w in zip(texts, got, want) if g != w] == []
    assert 49407 in got[-3]


def test_ids_by_words_over_a_table(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    got = list(ENCODER(pa.array(texts, pa.string())))
    assert all(x.tolist() == TOKENIZER.encode(t or "", add_special_tokens=False).ids + [2] for x, t in zip(got, texts))


def verify(got, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file())
    want = sorted(((d, t.encode(x or "", add_special_tokens=False).ids + [2]) for d, x in docs), key=str)
    by = {}
    for r in got:
        by.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    n = 0
    for d, ids in want:
        rows = by[d, len(ids)]
        assert len({r.start for r in rows}) * len([x for x in want if (x[0], len(x[1])) == (d, len(ids))]) == len(rows)
        for r in rows:
            if r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()):
                n += 1
    assert n >= len(got)
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for xs in seqs.values():
        end = 0
        for o, k in sorted(xs):
            assert o == end
            end = o + k
        assert end <= 4096
    assert sorted(seqs) == list(range(len(seqs)))
    return sum(len(x) for _, x in want) / len(seqs) / 4096


def test_pack(spark):
    docs = [(i, "word " * (i * 37 % 700)) for i in range(60)] + [(100, None), (101, ""), (102, "long text " * 9000), (103, "a"), (103, "a"), (None, "null id"), (104, "<|endoftext|>")]
    df = spark.createDataFrame([(d, t, 1, 2, 3) for d, t in docs], "doc_id long, text string, row int, length int, split int")
    verify(pack(df, tokenizer_file()).collect(), docs)
    ids = pack(df.where("doc_id = 103"), tokenizer_file(), with_ids=True).collect()
    assert [len(r.ids) for r in ids] == [2, 2]
    assert pack(df.where("false"), tokenizer_file()).count() == 0


def test_query_over_a_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert verify(op1_packing(spark, sf).collect(), docs) > 0.97
