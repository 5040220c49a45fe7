"""Look-ups in a property graph: ids, neighbours, search, members, contexts and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.graph import Graph, clean_id


def resolve(graph: Graph, names: DataFrame) -> DataFrame:
    """(name, id) by id, then by id without prefix, then by either without regard to case; the first id in order wins."""
    keyed = graph.nodes.select("id", clean_id(F.col("id")).alias("short"))
    exact = keyed.groupBy(F.col("id").alias("k1")).agg(F.min("id").alias("by_id"))
    short = keyed.groupBy(F.col("short").alias("k2")).agg(F.min("id").alias("by_short"))
    lower = keyed.select("id", F.explode(F.array(F.lower("id"), F.lower("short"))).alias("k3")).groupBy("k3").agg(F.min("id").alias("by_lower"))
    out = names.select("name").distinct()
    out = out.join(exact, F.col("name") == F.col("k1"), "left").join(short, F.col("name") == F.col("k2"), "left").join(lower, F.lower("name") == F.col("k3"), "left")
    return out.select("name", F.coalesce("by_id", "by_short", "by_lower").alias("id"))


def of_label(graph: Graph, label: str) -> DataFrame:
    return graph.nodes.filter(F.col("label") == label).select("id", "title")


def neighbours(graph: Graph, ids: DataFrame, direction: str = "both") -> DataFrame:
    """(id, nbr, rel_type, direction): a row for each type of each edge at the given ids."""
    out = graph.both_ways().join(ids.select("id").distinct(), "id", "left_semi")
    return out if direction == "both" else out.filter(F.col("direction") == direction)


def relationships(graph: Graph, ids: DataFrame) -> DataFrame:
    """Edges at the given ids with both ends' labels."""
    ends = graph.nodes.select("id", "label")
    own = ids.select(F.col("id").alias("i")).distinct()
    out = graph.edges.join(own, F.col("src") == F.col("i"), "left_semi")
    at = out.unionByName(graph.edges.join(own, F.col("dst") == F.col("i"), "left_semi").join(own, F.col("src") == F.col("i"), "left_anti"))
    at = at.join(ends.withColumnsRenamed({"id": "s", "label": "src_label"}), F.col("src") == F.col("s"))
    return at.join(ends.withColumnsRenamed({"id": "d", "label": "dst_label"}), F.col("dst") == F.col("d")).select("src", "src_label", "rel_type", "dst", "dst_label")


def search(graph: Graph, query: str, label: str | None = None, limit: int = 10) -> DataFrame:
    """Best matches of a substring: 1.0 for the whole title, 0.8 for one that contains it."""
    q = query.lower()
    nodes = graph.nodes.filter(F.col("label") == label) if label else graph.nodes
    hit = nodes.filter(F.lower("title").contains(q)).withColumn("score", F.when(F.lower("title") == q, 1.0).otherwise(0.8))
    return hit.orderBy(F.desc("score"), "id").limit(limit).select("id", "title", "score")


def subgraph(graph: Graph, ids: DataFrame, with_neighbours: bool = False) -> Graph:
    """The graph induced by the given ids, or by them and their neighbours."""
    ids = ids.select("id").distinct()
    if with_neighbours:
        ids = ids.unionByName(neighbours(graph, ids).select(F.col("nbr").alias("id"))).distinct()
    a, b = ids.select(F.col("id").alias("a")), ids.select(F.col("id").alias("b"))
    edges = graph.edges.join(a, F.col("src") == F.col("a"), "left_semi").join(b, F.col("dst") == F.col("b"), "left_semi")
    return Graph(graph.nodes.join(ids, "id", "left_semi"), edges)


def members(graph: Graph, rel_type: str = "MEMBER_OF", label: str = "Customer", least: float = 0.7) -> DataFrame:
    """(group, member): edges that are sure enough, from nodes of the label; of members with one base name the longest id stays."""
    edges = graph.of_type(rel_type)
    if "confidence" in edges.columns:
        edges = edges.filter(F.coalesce("confidence", F.lit(1.0)) >= least)
    base = F.regexp_replace(F.col("title"), r"\s*\([^)]+\)\s*$", "")
    people = graph.nodes.filter(F.col("label") == label).select("id", base.alias("base"))
    rows = edges.join(people, F.col("src") == F.col("id")).select(F.col("dst").alias("group"), F.col("src").alias("member"), "base")
    first = Window.partitionBy("group", "base").orderBy(F.desc(F.length("member")), "member")
    return rows.withColumn("n", F.row_number().over(first)).filter("n = 1").select("group", "member")


def linked(graph: Graph, label: str, other: str, *rel_types: str) -> DataFrame:
    """(id, other): distinct nodes of two labels joined by an edge of the types, in either direction."""
    at = graph.both_ways().filter(F.col("rel_type").isin(*rel_types))
    a = graph.nodes.filter(F.col("label") == label).select("id")
    b = graph.nodes.filter(F.col("label") == other).select(F.col("id").alias("other"))
    return at.join(a, "id", "left_semi").join(b, F.col("nbr") == F.col("other")).select("id", "other").distinct()


def statistics(graph: Graph) -> DataFrame:
    """One row: counts, mean degree (in and out) and density."""
    n = graph.nodes.agg(F.count("*").alias("n"))
    m = graph.edges.agg(F.count("*").alias("m"), F.count_distinct("rel_type").alias("n_types"))
    return n.crossJoin(m).select(F.col("n").alias("n_nodes"), F.col("m").alias("n_edges"), "n_types", F.round(2 * F.col("m") / F.col("n"), 6).alias("mean_degree"), F.round(F.col("m") / (F.col("n") * (F.col("n") - 1)), 12).alias("density"))


def context(graph: Graph, start: DataFrame, depth: int = 2) -> DataFrame:
    """(start, id, hops, rel_type): nodes within ``depth`` hops in either direction, with the first relation in order that reached each."""
    both = graph.both_ways().select("id", "nbr", "rel_type")
    level = start.select(F.col("id").alias("start"), F.col("id"), F.lit(0).alias("hops"), F.lit(None).cast("string").alias("rel_type"))
    seen = level
    for k in range(1, depth + 1):
        step = level.select("start", "id").join(both, "id").groupBy("start", F.col("nbr").alias("id")).agg(F.min("rel_type").alias("rel_type"))
        level = step.join(seen.select("start", "id"), ["start", "id"], "left_anti").select("start", "id", F.lit(k).alias("hops"), "rel_type")
        seen = seen.unionByName(level)
    return seen


def is_member(graph: Graph, pairs: DataFrame, *rel_types: str) -> DataFrame:
    """(src, dst, linked) for given pairs: whether an edge of the types joins them in either direction."""
    at = graph.both_ways().filter(F.col("rel_type").isin(*rel_types)).select("id", "nbr").distinct()
    return pairs.join(at, (F.col("src") == F.col("id")) & (F.col("dst") == F.col("nbr")), "left").select("src", "dst", F.col("id").isNotNull().alias("linked"))
