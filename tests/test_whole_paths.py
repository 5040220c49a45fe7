"""Paths without a bound on hops or sources, against brute force."""

from collections import Counter, defaultdict

from quern import plans
from quern.graph import similarity, trade

SF = "/root/testdata/sf0.001"


def adjacent(pairs):
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    return near


def paths_from(source, near, most):
    """{node: all shortest paths} within ``most`` edges."""
    found, level = {source: [(source,)]}, {source: [(source,)]}
    for _ in range(most):
        step = defaultdict(list)
        for u, ps in level.items():
            for v in near.get(u, ()):
                if v not in found:
                    step[v] += [(*p, v) for p in ps]
        found |= step
        level = step
    return {v: ps for v, ps in found.items() if v != source}


def test_all_shortest_paths(spark):
    g = similarity(spark, SF)
    near = adjacent((r["src"], r["dst"]) for r in g.edges.collect())
    want = Counter((s, v, len(p) - 1, p) for s in list(near) for v, ps in paths_from(s, near, 10).items() for p in ps)
    got = plans.queries()["p6_all_shortest_paths"](spark, SF).collect()
    assert Counter((r["src"], r["dst"], r["hops"], tuple(r["path"])) for r in got) == want
    assert max(r["hops"] for r in got) > 3


def test_directed_from_all_customers(spark):
    g = trade(spark, SF)
    near = defaultdict(set)
    for r in g.edges.collect():
        near[r["src"]].add(r["dst"])
    label = {r["id"]: r["label"] for r in g.nodes.collect()}
    want = {(s, v): min(ps) for s in label if label[s] == "Customer" for v, ps in paths_from(s, near, 5).items() if label[v] in ("Type", "Region")}
    got = plans.queries()["p2_directed_shortest"](spark, SF).collect()
    assert {(r["src"], r["dst"]): tuple(r["path"]) for r in got} == want and len(got) == len(want)
    assert len({r["src"] for r in got}) > 2


def test_a_hubs_pairs_are_dealt_out(spark):
    from pyspark.sql import functions as F

    from quern.operators import paths as P

    name, before = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(name, "-1")
    try:
        edges = spark.createDataFrame([(f"c{i}", "hub", "MEMBER_OF") for i in range(200)], "src string, dst string, rel_type string")
        parts = P.two_hops(edges, P.FEW).groupBy(F.spark_partition_id()).count().collect()
        whole = P.two_hops(edges, 10).count()
    finally:
        spark.conf.set(name, before)
    assert sum(r["count"] for r in parts) == whole == 200 * 199
    assert max(r["count"] for r in parts) < whole / 2


def test_simple_paths_are_not_dealt_out(spark):
    from quern.operators import paths as P

    name, before = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(name, "-1")
    try:
        edges = P.both_ways(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long"))
        starts = spark.createDataFrame([(i,) for i in range(1, 6)], "id long")
        held, dealt = P.simple_paths(edges, starts, few=P.FEW), P.simple_paths(edges, starts)
        assert "SortMergeJoin" not in held._jdf.queryExecution().toString() and "SortMergeJoin" in dealt._jdf.queryExecution().toString()
        told = [sorted((r["src"], r["dst"], r["hops"], tuple(r["path"])) for r in x.collect()) for x in (held, dealt)]
    finally:
        spark.conf.set(name, before)
    assert told[0] == told[1] and (1, 4, 3, (1, 2, 3, 4)) in told[0] and all(len(set(r[3])) == r[2] + 1 for r in told[0])
