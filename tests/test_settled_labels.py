"""Label propagation to its end, against brute force."""

from collections import Counter, defaultdict

from quern import plans
from quern.graph import similarity
from quern.operators import communities as C

SF = "/root/testdata/sf0.001"


def adjacent(pairs):
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    return near


def settled_labels(nodes, near):
    label, past = {v: v for v in nodes}, []
    while label not in past:
        past.append(label)
        votes = {v: Counter(label[u] for u in near[v]) for v in nodes}
        label = {v: min(votes[v], key=lambda c: (-votes[v][c], c)) if votes[v] else label[v] for v in nodes}
    return {v: min(x[v] for x in past[past.index(label) :]) for v in nodes}


def test_label_propagation(spark):
    pairs = [(i, i + 1) for i in range(1, 40)] + [(50, 51)]
    nodes = [*range(1, 41), 50, 51, 60]
    got = C.label_propagation(spark.createDataFrame([(i,) for i in nodes], "id long"), spark.createDataFrame(pairs, "a long, b long"))
    want = settled_labels(nodes, adjacent(pairs))
    assert {r["id"]: r["community"] for r in got.collect()} == want
    assert want[50] == want[51] == 50 and want[60] == 60


def test_label_propagation_query(spark):
    g = similarity(spark, SF)
    nodes = [r["id"] for r in g.nodes.collect()]
    want = settled_labels(nodes, adjacent((r["src"], r["dst"]) for r in g.edges.collect()))
    assert {r["id"]: r["community"] for r in plans.queries()["c3_label_propagation"](spark, SF).collect()} == want
