"""Sequential graph algorithms over neighbour lists."""

import random

import numpy as np
import pytest

from quern.operators import communities as C
from quern.packed import in_one_task, lists, packed


def made(spark, n=300, m=1500):
    rng = random.Random(3)
    pairs = {tuple(sorted(rng.sample(range(0, 3 * n, 3), 2))) for _ in range(m)}
    return {3 * i for i in range(n)}, pairs, spark.createDataFrame([(3 * i,) for i in range(n)], "id long"), spark.createDataFrame(sorted(pairs), "a long, b long")


def test_lists_have_every_link_at_both_ends(spark):
    ids, pairs, nodes, links = made(spark)
    g = packed(nodes, links.unionByName(links))
    starts, to = lists([r["data"] for r in g.blobs.collect()], g.n)
    got = {(3 * u, 3 * int(v)) for u in range(g.n) for v in to[starts[u] : starts[u + 1]]}
    assert got == pairs | {(b, a) for a, b in pairs} and len(to) == 2 * len(pairs) == 2 * g.m


def test_more_links_than_dictionaries_take(spark, monkeypatch):
    """Louvain and label propagation go on where the limit of the algorithms over dictionaries ends."""
    monkeypatch.setattr(C, "SMALL", 10)
    ids, pairs, nodes, links = made(spark)
    for find in (C.louvain, C.async_label_propagation):
        got = {r["id"]: r["community"] for r in find(nodes, links).collect()}
        assert set(got) == ids and set(got.values()) <= ids
        assert all(min(v for v in ids if got[v] == c) == c for c in set(got.values()))
    with pytest.raises(ValueError):
        packed(nodes, links, most_links=10)


def test_merged_keeps_weights():
    starts, to = np.array([0, 2, 4, 6, 6]), np.array([1, 2, 0, 2, 0, 1], np.int32)
    s, t, w = C.merged(starts, to, None, np.array([0, 0, 1, 2]), 3, most=2)
    assert s.tolist() == [0, 2, 3, 3] and t.tolist() == [0, 1, 0] and w.tolist() == [2, 2, 2]


def distances(ids, pairs):
    near = {v: set() for v in ids}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for s in ids:
        depth, todo = {s: 0}, [s]
        for v in todo:
            for u in sorted(near[v]):
                if u not in depth:
                    depth[u] = depth[v] + 1
                    todo.append(u)
        out |= {(s, v): k for v, k in depth.items()}
    return out


def test_hops_write_no_levels(spark, monkeypatch):
    """Distances and their counts by bits in tasks, some sources and few links at a time, whatever a table of levels would hold."""
    import quern.packed as K

    ids, pairs, nodes, links = made(spark, 150, 170)
    monkeypatch.setattr(K, "STARTS", 70)
    want = distances(ids, pairs)
    got = K.hops(packed(nodes, links)).collect()
    assert {(r["source"], r["id"]): r["hops"] for r in got} == want and len(got) == len(want)
    near_ = K.hops(packed(nodes, links), 2).collect()
    assert {(r["source"], r["id"]): r["hops"] for r in near_} == {p: k for p, k in want.items() if k <= 2}
    counts = {r["hops"]: r["n"] for r in K.lengths(packed(nodes, links), nodes).collect()}
    assert counts == {k: sum(x == k for x in want.values()) for k in set(want.values()) - {0}}


def test_levels_gather_a_few_links_at_a_time(monkeypatch):
    import quern.packed as K

    starts, to = np.array([0, 1, 3, 5, 6, 6]), np.array([1, 0, 2, 1, 3, 2], np.int32)
    monkeypatch.setattr(K, "GATHERED", 1)
    assert [x[:, 0].tolist() for x in K.levels(starts, to, np.array([0, 3]))] == [[0, 1, 2, 0, 0], [0, 2, 1, 0, 0], [2, 0, 0, 1, 0]]


def test_shares_are_brandes_dependencies():
    from quern.operators.analytics import dependencies, shares

    rng = random.Random(5)
    near = {v: set() for v in range(60)}
    for _ in range(90):
        a, b = rng.sample(range(60), 2)
        near[a].add(b)
        near[b].add(a)
    starts = np.cumsum([0, *(len(near[v]) for v in range(60))])
    to = np.array([u for v in range(60) for u in sorted(near[v])], np.int32)
    for s in range(60):
        want = dependencies(near, s)
        assert np.allclose(shares(starts, to, s), [want.get(v, 0.0) for v in range(60)], rtol=1e-12)


def test_betweenness_takes_more_links_than_dictionaries_did():
    import inspect

    from quern.operators.analytics import betweenness

    assert inspect.signature(betweenness).parameters["most_links"].default > 2_000_000


def merged_pair_by_pair(near):
    """Greedy modularity, with all gains weighed anew before each merge."""
    m2 = sum(len(w) for w in near.values())
    of, between, degree = {v: v for v in near}, {v: dict.fromkeys(w, 1.0) for v, w in near.items()}, {v: float(len(w)) for v, w in near.items()}
    while True:
        best = max(((2 * (x / m2 - degree[a] * degree[b] / m2**2), -a, -b) for a, w in between.items() for b, x in w.items() if a < b), default=(0,))
        if best[0] <= 1e-12:
            return of
        a, b = -best[1], -best[2]
        for c, x in between.pop(b).items():
            del between[c][b]
            if c != a:
                between[a][c] = between[c][a] = between[a].get(c, 0.0) + x
        degree[a] += degree.pop(b)
        of = {v: a if c == b else c for v, c in of.items()}


def test_greedy_modularity_over_lists(spark, monkeypatch):
    """The same merges as over dictionaries, ties included, and no limit of theirs."""
    rng = random.Random(9)
    for n, m, block in ((40, 60, 4), (60, 300, 7), (80, 70, 1024), (30, 15, 8)):
        near = {v: set() for v in range(n)}
        for _ in range(m):
            a, b = rng.sample(range(n), 2)
            near[a].add(b)
            near[b].add(a)
        starts = np.cumsum([0, *(len(near[v]) for v in range(n))])
        to = np.array([u for v in range(n) for u in sorted(near[v])], np.int32)
        want = merged_pair_by_pair(near)
        assert C.best_merges(starts, to, block).tolist() == [want[v] for v in range(n)]
    monkeypatch.setattr(C, "SMALL", 10)
    ids, pairs, nodes, links = made(spark)
    near = {v: {b for a, b in pairs | {(b, a) for a, b in pairs} if a == v} for v in ids}
    assert {r["id"]: r["community"] for r in C.greedy_modularity(nodes, links).collect()} == merged_pair_by_pair(near)


def test_shares_hold_a_bounded_part_of_the_links():
    import tracemalloc

    from quern.operators.analytics import shares

    n = 2500
    to = np.concatenate([np.delete(np.arange(n, dtype=np.int32), v) for v in range(n)])
    starts = np.arange(n + 1) * (n - 1)
    tracemalloc.start()
    got = shares(starts, to, 7)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert not got.any() and peak < 4 * to.nbytes


def test_clustering_makes_no_pairs_of_neighbours(spark, monkeypatch):
    from quern.operators import analytics as A

    ids, pairs, nodes, links = made(spark, 120, 1500)
    near = {v: {b for a, b in pairs if a == v} | {a for a, b in pairs if b == v} for v in ids}
    want = {v: sum(b in near[a] for a in x for b in x) / (len(x) * (len(x) - 1)) if len(x) > 1 else 0.0 for v, x in near.items()}
    by_joins = {r["id"]: r["clustering"] for r in A.clustering(nodes, links, most_links=10).collect()}
    monkeypatch.setattr(A, "triangles", lambda pairs: pytest.fail("triangles were joined"))
    by_lists = {r["id"]: r["clustering"] for r in A.clustering(nodes, links).collect()}
    assert by_lists == pytest.approx(want) and by_joins == pytest.approx(want) and max(want.values()) > 0


def test_mates_are_gathered_and_not_paired_up_by_work(spark, monkeypatch):
    from quern.graph import Graph
    from quern.operators import reasoning as Q

    rng = random.Random(8)
    edges = [(f"n{rng.randrange(40)}", f"n{rng.randrange(20, 60)}", "MADE") for _ in range(90)] + [("n1", "n2", "TIED"), ("n3", "n3", "TIED"), ("n70", "n4", "TIED"), (None, "n21", "MADE")]
    made = {(a, b) for a, b, t in edges if t == "MADE" and a}
    want = {(a, c) for a, b in made for c, d in made if b == d and a != c} | {("n1", "n2"), ("n2", "n1"), ("n70", "n4"), ("n4", "n70")}
    g = Graph(spark.createDataFrame([("n1", "x", "x")], "id string, label string, title string"), spark.createDataFrame(edges, "src string, dst string, rel_type string"))
    told = lambda df: sorted((r["id"], r["mate"]) for r in df.collect())
    assert told(Q.collaborators(g, "MADE", ("TIED",), most_links=5)) == sorted(want)
    monkeypatch.setattr(Q, "mates", lambda *a: pytest.fail("works were joined"))
    assert told(Q.collaborators(g, "MADE", ("TIED",))) == sorted(want)
