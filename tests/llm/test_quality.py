import numpy as np
import pytest

from quillspan.llm.quality import NAMES, discriminant, is_held_out, keep_good, score_quality, statistics


def test_statistics_take_any_text():
    for t in (None, b"", b" \n ", b"a", "é😀".encode(), b"x " * 100_000, b"||| |||", b"\n" * 50):
        x = statistics(t)
        assert len(x) == len(NAMES) and np.isfinite(x).all()
    assert statistics(None) == statistics(b"")


def test_score_is_the_difference_of_log_densities():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, (300, 3)), rng.normal(1.5, 2, (500, 3))])
    y = np.r_[np.zeros(300), np.ones(500)]
    n = np.array([300.0, 500.0])
    s = np.array([x[y == k].sum(axis=0) for k in (0, 1)])
    ss = np.array([x[y == k].T @ x[y == k] for k in (0, 1)])
    m = discriminant(n, s, ss, 0.0, 0.0)
    odds = []
    for k in (0, 1):
        z = x[y == k]
        mean, cov = z.mean(axis=0), np.cov(z.T, bias=True)
        d = x - mean
        odds.append(np.log((n[k] + 1) / 802) - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1])
    o = odds[1] - odds[0]
    assert np.allclose(m.score(x), 1 / (1 + np.exp(-np.sign(o) * np.log1p(np.abs(o)))), atol=1e-9)


@pytest.fixture(scope="module")
def tables(spark):
    sf = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


def test_held_out_accuracy(tables):
    docs, labels = tables
    rows = score_quality(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 50 and all(is_held_out(r.doc_id) for r in rows)
    assert np.mean([r.predicted == r.quality for r in rows]) >= 0.95
    assert all(r.predicted == (r.score >= 0.3) for r in rows)


def test_held_out_labels_and_other_columns_change_nothing(tables):
    docs, labels = tables
    from pyspark.sql import functions as F

    from quillspan.llm.quality import held_out

    plain = {r.doc_id: r.score for r in score_quality(docs, labels).collect()}
    turned = labels.withColumn("quality", F.when(held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    other = docs.withColumns({"lang": F.lit("xx"), "source": F.lit(None).cast("string"), "x": F.lit(1), "score": F.lit(2)})
    assert {r.doc_id: r.score for r in score_quality(other, turned).collect()} == pytest.approx(plain, abs=1e-9)


def test_edges(spark, tables):
    labels = tables[1]
    df = spark.createDataFrame([(1, None), (2, ""), (3, "plain words here."), (3, "plain words here."), (None, "x")], "doc_id long, text string")
    got = score_quality(df, labels).collect()
    scores = {}
    for r in got:
        scores.setdefault(r.doc_id, []).append(r.score)
    assert len(got) == 5 and scores[1] == scores[2] and len(set(scores[3])) == 1 and len(scores[3]) == 2  # null counts as empty, repeated rows alike
    assert [r.score for r in score_quality(df, labels.where("false")).collect()] == [0.5] * 5
    assert score_quality(df.where("false"), labels).count() == 0
    kept = keep_good(df, labels.where("false"))
    assert kept.columns == df.columns and kept.count() == 5 and keep_good(df.where("false"), labels).count() == 0
