"""Each stage of the pipeline on what its predecessor kept, against a plain version of it."""

import pandas as pd
import pytest

import corpus_pipeline
from quillspan.llm.queries import TARGET
from quillspan.llm.quality import fit, document_statistics, statistics

from .test_mixing_licences import count
from .test_packing import verify
from .test_simhash import exact_groups
from .test_substring import brute as brute_passages

COLUMNS = corpus_pipeline.COLUMNS


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """The smallest tables with rows that are null, empty, repeated or very long, and a column too many."""
    d = tmp_path_factory.mktemp("tables")
    docs = pd.read_parquet("/root/testdata/sf0.001/documents.parquet")
    good = docs.text[docs.text.str.len() > 400].tolist()
    more = [(9001, None, "en", "src0"), (9002, "", None, None), (9003, good[0], "en", "src1"), (9003, good[1], "en", "src1"), (None, good[2], "en", "src2"), (9004, " ".join(good[3:9]) * 4, "de", "src3"), (9005, good[4] + " and some more", "en", "src9")]
    docs = pd.concat([docs, pd.DataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in more], columns=COLUMNS)], ignore_index=True)
    docs["doc_id"], docs["seq"] = docs.doc_id.astype("Int64"), 1
    docs.to_parquet(d / "documents.parquet")
    pd.read_parquet("/root/testdata/sf0.001/labels.parquet").to_parquet(d / "labels.parquet")
    return str(d)


def rows_of(df):
    return [(r.doc_id, r.text, r.source) for r in df.collect()]


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)

    def step(name, docs):
        out = stages[name](spark, docs, sf_dir)
        path = f"{sf_dir}/{name}.parquet"
        out.write.parquet(path)
        out = spark.read.parquet(path)
        assert name == "packing" or out.columns == COLUMNS
        return out

    good = step("quality", docs)
    model = fit(document_statistics(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    import numpy as np

    assert sorted(rows_of(good), key=str) == sorted([r for r in rows_of(docs) if model.score(np.array([statistics((r[1] or "").encode())]))[0] >= 0.3], key=str)
    lone = step("near_duplicates", good)
    before = rows_of(good)
    groups = dict(exact_groups([(i, t) for i, (_, t, _) in enumerate(before)]))
    kept = rows_of(lone)
    assert len(kept) == len(set(groups.values())) and all(r in before for r in kept)
    of = {(d, t): groups[i] for i, (d, t, _) in enumerate(before)}
    assert len({of[d, t] for d, t, _ in kept}) == len(kept)
    for d, t, _ in kept:  # the smallest id of its group stays, rows without one only where there is no other
        ids = [x for (x, y), g in of.items() if g == of[d, t] and x is not None]
        assert d == (min(ids) if ids else None)
    cut = step("passages", lone)
    want = {(d, t): (n, k, text) for (d, t, _), (_, n, k, text) in zip(sorted(kept, key=lambda r: str((r[0], r[1]))), sorted_passages(kept))}
    assert sorted((d, t) for d, t, _ in rows_of(cut) if d is not None) == sorted((d, text if k else t) for (d, t), (n, k, text) in want.items() if d is not None)
    mixed = step("mixing", cut)
    assert sorted(rows_of(mixed), key=str) == sorted(expected_mix(rows_of(cut)), key=str)
    packed = step("packing", mixed)
    verify(packed.collect(), [(d, t) for d, t, _ in rows_of(mixed)])


def sorted_passages(kept):
    """Plain passages of the rows, in the order of their id and text."""
    order = sorted(kept, key=lambda r: str((r[0], r[1])))
    found = brute_passages([(i, t) for i, (_, t, _) in enumerate(order)])
    return [x for _, x in sorted((x[0], x) for x in found)]


def expected_mix(rows):
    sizes = {}
    for _, t, s in rows:
        sizes[s or ""] = sizes.get(s or "", 0) + len(t or "")
    weight = {s: TARGET.get(s, 1.0) for s, n in sizes.items() if n}
    total, all_weight = sum(sizes.values()), sum(weight.values())
    rate = {s: weight[s] / all_weight * total / n if n else 1.0 for s, n in sizes.items()}
    return [(d, t, s) for d, t, s in rows for _ in range(count("mix", "null" if d is None else d, rate[s or ""]))]


def test_empty_tables(spark, sf_dir, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").where("false").write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
