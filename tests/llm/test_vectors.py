"""Top-k and near-duplicate vectors against brute force."""

import numpy as np
import pytest

from quern.llm import hnsw, topk

ODD = [(2000, None), (2001, [float("nan")] * 8), (2002, [None] * 8), (2003, [0.0] * 8), (2050, [float("inf")] * 8), (None, [1.0] * 8), (2100, [1.0, 2.0]), (2101, [1.0, 2.1]), (2150, []), (2151, [])]


def table(spark, seed, n, dims=8, clusters=6):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims))
    for c in range(clusters):
        x[c * 20 : c * 20 + 20] = x[c * 20] + 0.1 * rng.normal(size=(20, dims))
    x[150:170] = x[150]
    rows = [(i, [float(v) for v in np.float32(r)]) for i, r in enumerate(x)]
    return rows, spark.createDataFrame([*rows, *ODD], "vec_id long, embedding array<float>")


def brute_top(rows, k=5, of=50):
    v = {i: [int(np.floor(256 * x)) for x in e] for i, e in rows}
    out = set()
    for q in (i for i in v if i % of == 0):
        best = sorted((-sum(a * b for a, b in zip(v[q], e)), i) for i, e in v.items() if i != q and len(e) == len(v[q]))[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    return out


@pytest.mark.parametrize("shard,block", [(8192, 2048), (64, 3)])
def test_top_k(spark, shard, block):
    rows, df = table(spark, 1, 400)
    good = [*rows, (2003, [0.0] * 8), (2100, [1.0, 2.0]), (2101, [1.0, 2.1]), (2150, []), (2151, [])]
    got = topk.top_k(df, df["vec_id"] % 50 == 0, shard=shard, block=block)
    assert {tuple(r) for r in got.collect()} == brute_top(good)


def test_top_k_few_ties_large_and_empty(spark):
    rows = [(0, [1.0]), (7, [1.0]), (3, [1.0]), (5, [2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(df, df["vec_id"] == 0).orderBy("rank").collect()] == [(0, 1, 5, 131072), (0, 2, 3, 65536), (0, 3, 7, 65536)]
    huge = spark.createDataFrame([(0, [3e6, 1.0]), (1, [3e6, 1.0]), (2, [-3e6, 1e-3])], "vec_id long, embedding array<double>")
    assert {tuple(r) for r in topk.top_k(huge, huge["vec_id"] == 0).collect()} == brute_top([(0, [3e6, 1.0]), (1, [3e6, 1.0]), (2, [-3e6, 1e-3])])
    assert topk.top_k(df.limit(0), df["vec_id"] == 0).count() == 0


def test_the_walk_stops_early():
    rng = np.random.default_rng(4)
    x = np.floor(256 * rng.exponential(size=(5000, 3)))
    walked = []
    lists = topk.Lists(np.arange(5000), x)
    got = list(zip(*lists.top(x[7], 7, 5, walked)))
    want = sorted((-int(s), i) for i, s in enumerate(x @ x[7]) if i != 7)[:5]
    assert got == [(i, -s) for s, i in want] and walked[0] < 1000
    parts = [topk.Lists(np.arange(a, 5000, 3), x[a::3]) for a in range(3)]
    best = None
    for p in parts:
        best = p.top(x[7], 7, 5, best=best)
    assert list(zip(*best)) == got


def test_top_k_beyond_doubles_and_longs(spark):
    """Products beyond 2 ** 53 are exact, components that overflow take no part, scores beyond 64 bits are refused."""
    rows = [(0, [2.0**20, 1.0]), (1, [2.0**20, 3.0]), (2, [-(2.0**20), 5.0]), (3, [2.0**20 + 2**-8, 0.0]), (4, [1e307, 1.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    assert {tuple(r) for r in topk.top_k(df, df["vec_id"] == 0).collect()} == brute_top(rows[:4])
    far = spark.createDataFrame([(0, [1e15]), (1, [1e15])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="OverflowError"):
        topk.top_k(far, far["vec_id"] == 0).collect()


def brute_links(rows, least=0.9):
    ids, x = np.array([i for i, _ in rows]), np.array([e for _, e in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= least) & ~np.eye(len(x), dtype=bool)
    label = np.arange(len(x))
    for _ in range(len(x)):
        new = np.minimum(label, np.where(near, label[None, :], len(x)).min(1))
        if (new == label).all():
            break
        label = new
    return {int(i): (int(k), int(ids[c])) for i, k, c in zip(ids, near.sum(1), label)}


@pytest.mark.parametrize("copies,shards", [(1000, 8), (3, 2)])
def test_near_duplicates(spark, copies, shards, monkeypatch):
    monkeypatch.setattr(hnsw, "COPIES", copies)
    rows, df = table(spark, 2, 600, dims=16)
    odd = [(i, e and e * 2) for i, e in ODD[:6]]
    df = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<float>")
    want = brute_links(rows)
    got = {r["vec_id"]: r for r in hnsw.near_duplicates(df, shards=shards).collect()}
    assert set(got) == set(want) | {i for i, _ in odd}
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i, _ in odd)
    true = sum(k for k, _ in want.values())
    assert all(got[i]["n_links"] <= k for i, (k, _) in want.items())
    assert sum(got[i]["n_links"] for i in want) >= 0.97 * true
    assert np.mean([got[i]["component_id"] == c for i, (_, c) in want.items()]) > 0.97
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_recall_on_the_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    want = brute_links([(r["vec_id"], r["embedding"]) for r in df.collect()])
    got = {r["vec_id"]: r for r in hnsw.near_duplicates(df).collect()}
    assert sum(got[i]["n_links"] for i in want) >= 0.95 * sum(k for k, _ in want.values())
    assert hnsw.near_duplicates(df.limit(0)).count() == 0


def clusters(seed, number, size, dims=32):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(number, dims))
    x = np.repeat(centre, size, axis=0) + 0.05 * rng.normal(size=(number * size, dims))
    return x[rng.permutation(len(x))]


def test_tight_clusters_are_not_islands():
    """Clusters larger than a node's candidates: the graph is navigated between them, or it is not used."""
    x = clusters(5, 40, 45)
    g = hnsw.Graph.built(np.arange(len(x)), np.ones(len(x), np.int64), x, 0.9, hnsw.unit(clusters(5, 40, 5)))
    v = hnsw.unit(x)
    true = v @ v.T >= 0.9
    q, node, _ = g.search(v, 0.9)
    assert len(set(zip(q.tolist(), node.tolist()))) == len(q) >= hnsw.AUDIT * true.sum()


def test_a_failed_audit_is_not_accepted(monkeypatch):
    x = clusters(6, 30, 30)
    monkeypatch.setattr(hnsw, "layer_built", lambda x, upper, most: np.full((len(x), 2), -1))  # no node leads to another
    g = hnsw.Graph.built(np.arange(len(x)), np.ones(len(x), np.int64), x, 0.9)
    assert g.beam == 0
    q, node, _ = g.search(g.exact, 0.9)
    assert len(q) == (g.exact @ g.exact.T >= 0.9).sum()


def test_links_count_at_both_ends(spark):
    """What one end counts the other does, in dense groups and out of them; ties, repeated rows and other columns change nothing."""
    x = clusters(7, 12, 60, 16)
    rows = [(int(i), [float(f) for f in e], "x", 3) for i, e in zip(np.random.default_rng(1).permutation(3 * len(x))[: len(x)], x)]
    rows += [(r[0] + 10_000, *r[1:]) for r in rows[:30]] + rows[40:45]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rep string, n_links int").repartition(5)
    got = hnsw.near_duplicates(df, shards=3).collect()
    assert len(got) == len(rows)
    v = hnsw.unit(np.array([r[1] for r in rows]))
    true = (v @ v.T >= 0.9).sum() - len(v)
    links = sum(r["n_links"] for r in got)
    assert links % 2 == 0 and 0.95 * true <= links <= true
    assert len({r["component_id"] for r in got}) == 12
