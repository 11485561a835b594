import numpy as np
import pytest

from quillspan.llm import embeddings
from quillspan.llm.embeddings import embedding_components
from quillspan.llm.queries import op9_embeddings


def brute(rows, threshold=0.95):
    ok = [bool(v) and None not in v and all(np.isfinite(v)) and any(v) for _, v in rows]
    n = len(rows)
    link = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            if i != j and ok[i] and ok[j] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                link[i, j] = a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold
    label = [d for d, _ in rows]
    changed = True
    while changed:
        changed = False
        for i, j in zip(*np.nonzero(link)):
            if label[j] < label[i]:
                label[i], changed = label[j], True
    return sorted((d, int(link[i].sum()), label[i], label[i] == d) for i, (d, _) in enumerate(rows))


def sample():
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 64))
    rows = [x for b in base for x in [b, *(b + 0.05 * rng.standard_normal((4, 64)))]]
    rows = [list(map(float, np.float32(x))) for x in rows]
    rows += [rows[0], rows[0], [2 * x for x in rows[1]], None, [], [0.0] * 64, [1.0, None], [float("nan")] * 64, [float("inf")] + [1.0] * 63, [1.0, 2.0], [2.0, 4.0], rows[7] + [0.0]]
    order = rng.permutation(len(rows))
    return [(int(i), x) for i, x in zip(order, rows)]


@pytest.mark.parametrize("block,chunk,fewest", [(8192, 100_000, 256), (8, 100_000, 256), (8, 5, 256), (8192, 100_000, 4096)])
def test_components_equal_brute_force(spark, monkeypatch, block, chunk, fewest):
    """Blocks of units, parts of inverted lists and the larger index are made to occur on a small table."""
    monkeypatch.setattr(embeddings, "BLOCK", block)
    monkeypatch.setattr(embeddings, "CHUNK", chunk)
    monkeypatch.setattr(embeddings, "FEWEST", fewest)
    rows = sample()
    df = spark.createDataFrame([(d, v, 1, 2, "x") for d, v in rows], "vec_id long, embedding array<float>, label int, n int, vec string")
    got = embedding_components(df)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, got.collect())) == brute(rows)
    assert embedding_components(df.where("false")).count() == 0


def test_recall_on_a_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(map(tuple, op9_embeddings(spark, sf).collect())) == brute(rows)


def test_parts_of_long_lists_lose_no_pair():
    rng = np.random.default_rng(2)
    count = 40
    top = np.sort(np.stack([rng.permutation(count)[:8] for _ in range(300)]), axis=1).astype(np.int16)
    top[100:] = top[rng.integers(0, 100, 200)]
    rep = np.arange(300)
    pairs = {}
    for i in range(7):
        for j in range(i + 1, 7):
            for k in range(300):
                pairs.setdefault((int(top[k, i]) * count + int(top[k, j])), []).append(k)
    number = np.concatenate([np.full(len(v), k) for k, v in sorted(pairs.items())])
    member = np.concatenate([v for _, v in sorted(pairs.items())])
    want = {}
    for a in range(300):
        for b in range(a):
            low = np.intersect1d(top[a], top[b])[:3]
            if len(low) == 3:
                want.setdefault(int(low[0] * count + low[1]) * count + int(low[2]), set()).update((a, b))
    for whole in (True, False):
        unit, who = embeddings.members_of_lists(number, rep[member], top[member], count, whole)
        got = {}
        for u, r in zip(unit.tolist(), who.tolist()):
            got.setdefault(u, set()).add(r)
        assert all(v <= got.get(u, set()) for u, v in want.items())
        assert whole is False or sum(map(len, got.values())) < 2 * sum(map(len, want.values()))


@pytest.mark.parametrize("n", [1000, 100_000, 10**7, 10**12])
@pytest.mark.parametrize("dim", [16, 64, 256])
def test_recall_at_the_threshold(n, dim):
    """Pairs at a cosine of 0.95 to 0.96 that share enough pivots, at the index sizes of small and of huge inputs."""
    count, listed = embeddings.index_size(n)
    rng = np.random.default_rng(9)
    x = rng.standard_normal((400, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal(x.shape)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    c = rng.uniform(0.95, 0.96, (400, 1))
    a, b = (embeddings.permutations_of(y, count, listed) for y in (x, c * x + np.sqrt(1 - c * c) * z))
    shared = (a[:, :, None] == b[:, None, :]).any(axis=2).sum(axis=1)
    assert (shared >= embeddings.SHARED).mean() >= 0.95


def test_rows_without_an_id(spark):
    v = [1.0, 2.0, 3.0]
    df = spark.createDataFrame([(None, v), (None, [-1.0, 5.0, 0.5]), (None, [-1.0, 5.0, 0.5001]), (4, [1.0, 2.0, 3.0001])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, embedding_components(df).collect()), key=str) == [(4, 1, 4, True), (None, 1, 4, False), (None, 1, None, False), (None, 1, None, False)]
