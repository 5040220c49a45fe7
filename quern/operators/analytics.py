"""Network analytics over simple undirected graphs: nodes(id) and pairs(a, b) with a < b."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.iterate import settled
from quern.operators.paths import hops
from quern.packed import LINKS, NODES, TooLarge, around, closed_pairs, lengths, over_sources, packed


def adjacency(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id"), F.col("b").alias("nbr")).unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("nbr")))


def components(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, component): smallest id that can be reached, by alternating large and small stars.

    A round moves every link onto the smallest neighbour of its ends, first for larger neighbours, then for smaller ones, until
    all links are stars around their component's smallest id.
    """
    stars = settled(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    seen = None
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = settled(both.join(low, F.col("u") == F.col("w")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.withColumnRenamed("u", "w"), F.col("u") == F.col("w")).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = settled(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        row = F.xxhash64("u", "v")
        now = stars.agg(F.count("*"), F.bit_xor(row), F.sum(row.cast("decimal(20,0)"))).first()
        if now == seen:
            break
        seen = now
    return nodes.select("id").join(stars, F.col("id") == F.col("u"), "left").select("id", F.coalesce("v", "id").alias("component"))


def largest_component(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id) of the largest component, the one with the smallest label among equals."""
    label = settled(components(nodes, pairs))
    top = label.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return label.join(F.broadcast(top.select("component")), "component").select("id")


def degrees(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    d = adjacency(pairs).groupBy("id").agg(F.count("*").alias("degree"))
    return nodes.select("id").join(d, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def degree_centrality(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    n = nodes.agg((F.count("*") - 1).alias("others"))
    return degrees(nodes, pairs).crossJoin(F.broadcast(n)).select("id", F.when(F.col("others") > 0, F.col("degree") / F.col("others")).otherwise(0.0).alias("centrality"))


def degree_histogram(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    return degrees(nodes, pairs).groupBy("degree").agg(F.count("*").alias("n"))


def triangles(pairs: DataFrame) -> DataFrame:
    """(x, y, z), x < y < z, each triangle once. Edges point from the end of lower degree, which keeps hubs' fan-out small."""
    d = adjacency(pairs).groupBy("id").agg(F.count("*").alias("d"))
    at = pairs.join(d.withColumnsRenamed({"id": "a", "d": "da"}), "a").join(d.withColumnsRenamed({"id": "b", "d": "db"}), "b")
    up = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    e = settled(at.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("lo"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("hi")))
    wedge = e.select("lo", F.col("hi").alias("u")).join(e.select(F.col("lo").alias("l2"), F.col("hi").alias("v")), (F.col("lo") == F.col("l2")) & (F.col("u") < F.col("v")))
    closed = wedge.join(pairs, (F.col("u") == F.col("a")) & (F.col("v") == F.col("b")), "left_semi")
    three = F.array_sort(F.array("lo", "u", "v"))
    return closed.select(three[0].alias("x"), three[1].alias("y"), three[2].alias("z"))


def clustering(nodes: DataFrame, pairs: DataFrame, most_nodes: int = NODES, most_links: int = LINKS) -> DataFrame:
    """(id, clustering): closed share of each node's neighbour pairs, 0 below two neighbours.

    Neighbours' links are counted over neighbour lists, of which no pair of neighbours is made; larger graphs' triangles are joined.
    """
    try:
        return _clustering(nodes, closed_pairs(packed(nodes, pairs, most_nodes, most_links)))
    except TooLarge:
        t = triangles(pairs).select(F.explode(F.array("x", "y", "z")).alias("id")).groupBy("id").agg(F.count("*").alias("closed"))
        return _clustering(nodes, degrees(nodes, pairs).join(t, "id", "left"))


def _clustering(nodes: DataFrame, counts: DataFrame) -> DataFrame:
    d, t = F.coalesce("degree", F.lit(0)), F.coalesce("closed", F.lit(0))
    return nodes.select("id").join(counts, "id", "left").select("id", F.when(d < 2, 0.0).otherwise(2 * t / (d * (d - 1))).alias("clustering"))


def path_lengths(nodes: DataFrame, pairs: DataFrame, sources: int | None = None) -> DataFrame:
    """(source, id, hops) between different nodes of the largest component, from all or ``sources`` hash-chosen nodes."""
    own = settled(largest_component(nodes, pairs))
    start = own if sources is None else own.orderBy(F.xxhash64("id"), "id").limit(sources)
    near = adjacency(pairs).select(F.col("id").alias("src"), F.col("nbr").alias("dst"))
    return hops(near, start).filter("hops > 0")


def path_length_counts(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(hops, n): ordered pairs of different nodes of the largest component by their distance, of which no row is made."""
    own = settled(largest_component(nodes, pairs))
    return lengths(packed(nodes, pairs), own)


def small_world(nodes: DataFrame, pairs: DataFrame, sources: int | None = None) -> DataFrame:
    """One row: size, mean path, clustering over the whole graph, their random expectations over the largest component, and the verdicts."""
    own = settled(largest_component(nodes, pairs))
    try:
        graph = packed(nodes, pairs)
    except TooLarge:
        if sources is None:
            raise
        graph = None
    counts = lengths(graph, own) if sources is None else path_lengths(nodes, pairs, sources).groupBy("hops").agg(F.count("*").alias("n"))
    length = counts.agg((F.sum(F.col("hops") * F.col("n")) / F.sum("n")).alias("mean_path"), F.max("hops").alias("diameter"))
    inside = pairs.join(own.withColumnRenamed("id", "a"), "a", "left_semi").join(own.withColumnRenamed("id", "b"), "b", "left_semi")
    size = own.agg(F.count("*").alias("n")).crossJoin(inside.agg(F.count("*").alias("m")))
    mean = (clustering(nodes, pairs) if graph is None else _clustering(nodes, closed_pairs(graph))).agg(F.avg("clustering").alias("clustering"))
    row = size.crossJoin(length).crossJoin(mean).withColumn("mean_degree", 2 * F.col("m") / F.col("n"))
    row = row.withColumn("random_path", F.log("n") / F.log("mean_degree")).withColumn("random_clustering", F.col("mean_degree") / F.col("n"))
    row = row.withColumn("sigma", (F.col("clustering") / F.col("random_clustering")) / (F.col("mean_path") / F.col("random_path")))
    return row.withColumn("short_paths", F.col("mean_path") < 2 * F.log("n")).withColumn("clustered", F.col("clustering") > 10 * F.col("random_clustering")).withColumn("is_small_world", F.col("short_paths") & F.col("clustered"))


def pagerank(nodes: DataFrame, pairs: DataFrame, alpha: float = 0.85, rounds: int = 20, tolerance: float | None = None) -> DataFrame:
    """(id, rank): power iteration over both directions; the rank of nodes without neighbours is spread evenly."""
    n = nodes.count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("rank"))
    near = adjacency(pairs)
    d = near.groupBy("id").agg(F.count("*").alias("degree"))
    near = settled(near.join(d, "id"))
    lone = nodes.select("id").join(d.select("id"), "id", "left_anti").count()
    rank, stray = settled(nodes.select("id", F.lit(1.0 / n).alias("rank"))), 1.0 / n
    for _ in range(rounds):
        got = near.join(rank, "id").groupBy(F.col("nbr").alias("id")).agg(F.sum(F.col("rank") / F.col("degree")).alias("got"))
        base = (1 - alpha) / n + alpha * lone * stray / n  # nodes without neighbours all have the same rank
        new = settled(rank.join(got, "id", "left").select("id", (F.lit(base) + alpha * F.coalesce("got", F.lit(0.0))).alias("rank"), F.col("rank").alias("old")))
        rank, stray = new.select("id", "rank"), base
        if tolerance is not None and new.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] < n * tolerance:
            break
    return rank


def ranking(values: DataFrame, nodes: DataFrame, value: str, k: int = 10) -> DataFrame:
    """(place, id, label, value): the ``k`` highest values, ties by id."""
    top = values.join(nodes.select("id", "label"), "id").orderBy(F.desc(value), "id").limit(k)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc(value), "id"))).select("place", "id", "label", value)


def by_label(values: DataFrame, nodes: DataFrame, value: str) -> DataFrame:
    """(label, n, mean, top): count, mean and best node of each label."""
    at = values.join(nodes.select("id", "label"), "id")
    best = F.min_by("id", F.struct(-F.col(value), F.col("id")))
    return at.groupBy("label").agg(F.count("*").alias("n"), F.avg(value).alias("mean"), best.alias("top"))


def betweenness(nodes: DataFrame, pairs: DataFrame, sources: int | None = None, most_nodes: int = NODES, most_links: int = LINKS) -> DataFrame:
    """(id, betweenness), normalised: Brandes' dependencies from all or ``sources`` hash-chosen nodes.

    Sources are spread over the cluster; each task holds the links as neighbour lists, for up to ``most_nodes`` nodes and ``most_links`` links.
    """
    graph = packed(nodes, pairs, most_nodes, most_links)
    n = nodes.count()
    start = nodes.select("id") if sources is None else nodes.select("id").orderBy(F.xxhash64("id"), "id").limit(sources)
    used = n if sources is None else min(n, sources)

    def run(starts: np.ndarray, to: np.ndarray, own: np.ndarray) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(starts) - 1)
        for s in own:
            total += shares(starts, to, int(s))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["v", "part"])

    parts = over_sources(graph, run, "v int, part double", start).groupBy("v").agg(F.sum("part").alias("part"))
    parts = parts.join(graph.numbered, F.col("v") == F.col("number")).select("id", "part")
    scale = 1.0 / ((n - 1) * (n - 2)) * n / used if n > 2 else 0.0
    return nodes.select("id").join(parts, "id", "left").select("id", (F.coalesce("part", F.lit(0.0)) * scale).alias("betweenness"))


def shares(starts: np.ndarray, to: np.ndarray, source: int) -> np.ndarray:
    """What dependencies() gives, by node, over neighbour lists; links between two levels are looked up from the side that has fewer."""
    n = len(starts) - 1
    degree = np.diff(starts)
    depth, count, share = np.full(n, -1, np.int32), np.zeros(n), np.zeros(n)
    depth[source], count[source] = 0, 1
    levels, far = [np.array([source])], np.flatnonzero((depth < 0) & (degree > 0))

    def between(some: np.ndarray, other: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(x, y): links from ``some`` to nodes of depth ``other``."""
        for part, y in around(starts, to, some):
            hit = depth[y] == other
            yield np.repeat(part, degree[part])[hit], y[hit]

    def linked(low: np.ndarray, high: np.ndarray, k: int, above: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(v, w): links from ``low``, all nodes of depth k - 1, to ``high``, all of depth ``above``."""
        if degree[low].sum() <= degree[high].sum():
            yield from between(low, above)
        else:
            yield from ((v, w) for w, v in between(high, k - 1))

    while len(levels[-1]) and len(far):
        for v, w in linked(levels[-1], far, len(levels), -1):
            count += np.bincount(w, count[v], n)
        new = count[far] > 0
        depth[far[new]] = len(levels)
        levels.append(far[new])
        far = far[~new]
    for k in range(len(levels) - 1, 0, -1):
        for v, w in linked(levels[k - 1], levels[k], k, k):
            share += np.bincount(v, count[v] / count[w] * (1 + share[w]), n)
    share[source] = 0
    return share


def dependencies(near: dict, source) -> dict:
    """Each node's share of the shortest paths from ``source``: path counts level by level, then shares backwards."""
    depth, count, levels = {source: 0}, {source: 1}, [[source]]
    while levels[-1]:
        nxt: dict = {}
        for v in levels[-1]:
            for w in near.get(v, ()):
                if w not in depth or depth[w] == len(levels):
                    nxt[w] = nxt.get(w, 0) + count[v]
                    depth[w] = len(levels)
        count |= nxt
        levels.append(list(nxt))
    share = dict.fromkeys(depth, 0.0)
    for k in range(len(levels) - 1, 0, -1):
        for w in levels[k]:
            for v in near[w]:
                if depth.get(v) == k - 1:
                    share[v] += count[v] / count[w] * (1 + share[w])
    share.pop(source)
    return share
