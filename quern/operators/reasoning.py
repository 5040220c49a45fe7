"""Questions over the graph as joins: every question of a kind is answered at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.graph import Graph
from quern.packed import LINKS, NODES, TooLarge, packed, two_steps


def chain(graph: Graph, starts: DataFrame, steps: list[str], label: str | None = None) -> DataFrame:
    """(start, answer): distinct ends of a fixed chain of relation types; ``<T`` walks T backwards."""
    at = starts.select(F.col("id").alias("start"), F.col("id").alias("at"))
    for s in steps:
        a, b = ("dst", "src") if s[0] == "<" else ("src", "dst")
        step = graph.of_type(s.lstrip("<")).select(F.col(a).alias("from"), F.col(b).alias("to"))
        at = at.join(step, F.col("at") == F.col("from")).select("start", F.col("to").alias("at")).distinct()
    if label:
        at = at.join(graph.nodes.filter(F.col("label") == label).select("id"), F.col("at") == F.col("id"), "left_semi")
    return at.select("start", F.col("at").alias("answer"))


def count_in_ball(graph: Graph, starts: DataFrame, hops: int) -> DataFrame:
    """(start, label, n): other nodes within ``hops`` in either direction, counted by label."""
    both = graph.both_ways().select("id", "nbr").distinct()
    seen = level = starts.select(F.col("id").alias("start"), "id")
    for _ in range(hops):
        level = level.join(both, "id").select("start", F.col("nbr").alias("id")).distinct().join(seen, ["start", "id"], "left_anti")
        seen = seen.unionByName(level)
    return seen.filter("id <> start").join(graph.nodes.select("id", "label"), "id").groupBy("start", "label").agg(F.count("*").alias("n"))


def compare(graph: Graph, first: str, second: str) -> DataFrame:
    """(side, rel_type, nbr): relations that both have, only the first has, only the second has."""
    of = lambda i: graph.both_ways().filter(F.col("id") == i).select("rel_type", "nbr").distinct()
    a, b = of(first), of(second)
    named = lambda df, side: df.select(F.lit(side).alias("side"), "rel_type", "nbr")
    return named(a.intersect(b), "both").unionByName(named(a.subtract(b), "first")).unionByName(named(b.subtract(a), "second"))


def common_neighbours(graph: Graph, ids: list[str]) -> DataFrame:
    at = graph.both_ways().filter(F.col("id").isin(*ids))
    return at.groupBy("nbr").agg(F.count_distinct("id").alias("n")).filter(F.col("n") == len(set(ids))).select(F.col("nbr").alias("id"))


def confidence(hops: Column) -> Column:
    """0.9 for each of the first two hops, 0.8 for each further one."""
    return F.pow(F.lit(0.9), F.least(hops, F.lit(2))) * F.pow(F.lit(0.8), F.greatest(hops - 2, F.lit(0)))


def _pairs(has: DataFrame) -> DataFrame:
    """(a, b, via) for ids that have a value in common: ``has`` is (id, value)."""
    has = has.distinct()
    a, b = has.select(F.col("id").alias("a"), F.col("value").alias("via")), has.select(F.col("id").alias("b"), F.col("value").alias("v"))
    return a.join(b, (F.col("via") == F.col("v")) & (F.col("a") < F.col("b"))).select("a", "b", "via")


def sharing(graph: Graph, rel_type: str) -> DataFrame:
    """Pairs of sources with a target of the type in common."""
    return _pairs(graph.of_type(rel_type).select(F.col("src").alias("id"), F.col("dst").alias("value")))


def sharing_via(graph: Graph, ids: DataFrame, group_type: str, rel_type: str) -> DataFrame:
    """Pairs of ``ids`` whose groups have a target of the type in common."""
    return _pairs(direct_or_via(graph, ids, rel_type, group_type).select("id", F.col("answer").alias("value")))


def mates(graph: Graph, rel_type: str) -> DataFrame:
    """(id, mate): others with the same target."""
    p = sharing(graph, rel_type)
    return p.select(F.col("a").alias("id"), F.col("b").alias("mate")).unionByName(p.select(F.col("b").alias("id"), F.col("a").alias("mate"))).distinct()


def getter(graph: Graph, rel_type: str, label: str | None = None, backwards: bool = False) -> DataFrame:
    """(id, answer) over one edge of the type."""
    a, b = ("dst", "src") if backwards else ("src", "dst")
    at = graph.of_type(rel_type).select(F.col(a).alias("id"), F.col(b).alias("answer")).distinct()
    return at.join(graph.nodes.filter(F.col("label") == label).select(F.col("id").alias("n")), F.col("answer") == F.col("n"), "left_semi") if label else at


def direct_or_via(graph: Graph, ids: DataFrame, rel_type: str, group_type: str) -> DataFrame:
    """(id, answer): own targets of the type and those of the groups that the ids belong to."""
    own = ids.select("id").distinct()
    step = graph.of_type(rel_type).select(F.col("src").alias("from"), F.col("dst").alias("answer"))
    direct = own.join(step, F.col("id") == F.col("from")).select("id", "answer")
    groups = graph.of_type(group_type).select(F.col("src").alias("m"), F.col("dst").alias("group"))
    via = own.join(groups, F.col("id") == F.col("m")).join(step, F.col("group") == F.col("from")).select("id", "answer")
    return direct.unionByName(via).distinct()


def quantified(graph: Graph, rel_type: str, holds: DataFrame) -> DataFrame:
    """(group, all_hold, any_hold): whether a condition, given as (id, holds), holds for all or any of each group's members."""
    at = graph.of_type(rel_type).join(holds, F.col("src") == F.col("id"))
    return at.groupBy(F.col("dst").alias("group")).agg(F.bool_and("holds").alias("all_hold"), F.bool_or("holds").alias("any_hold"))


def shared(asked: DataFrame, has: DataFrame) -> DataFrame:
    """(a, b, same, common): for the asked pairs (a, b), whether and in which values (id, value) the two ends agree.

    Pairs meet the values by equi-joins from either end, so a value that many ids have makes no pairs of its own.
    """
    has = has.select("id", "value").distinct()
    left = asked.select("a", "b").distinct().join(has.select(F.col("id").alias("x"), "value"), F.col("a") == F.col("x")).select("a", "b", "value")
    both = left.join(has.select(F.col("id").alias("y"), F.col("value").alias("v")), (F.col("b") == F.col("y")) & (F.col("value") == F.col("v")))
    found = both.groupBy(F.col("a").alias("f_a"), F.col("b").alias("f_b")).agg(F.sort_array(F.collect_set("value")).alias("common"))
    at = asked.select("a", "b").distinct().join(found, (F.col("a") == F.col("f_a")) & (F.col("b") == F.col("f_b")), "left")
    return at.select("a", "b", F.col("common").isNotNull().alias("same"), F.coalesce("common", F.array().cast(has.schema["value"].dataType.simpleString().join(("array<", ">")))).alias("common"))


def values_via(graph: Graph, has: DataFrame, group_type: str) -> DataFrame:
    """(id, value): the values (id, value) of each node's own and of the groups it belongs to."""
    step = graph.of_type(group_type).select(F.col("src").alias("member"), F.col("dst").alias("group"))
    via = step.join(has.select(F.col("id").alias("g"), "value"), F.col("group") == F.col("g")).select(F.col("member").alias("id"), "value")
    return has.select("id", "value").unionByName(via).distinct()


def collaborators(graph: Graph, work_type: str, explicit: tuple[str, ...] = (), most_nodes: int = NODES, most_links: int = LINKS) -> DataFrame:
    """(id, mate): others with a work in common, or tied by an explicit relation, either way.

    Those of one work are not paired up: each one's mates are gathered over neighbour lists. Larger graphs' works are joined.
    """
    works = graph.of_type(work_type).select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct()
    # an id may be a person's and a work's
    of = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.col(c).alias("id"))
    try:
        two_kinds = packed(works.select(of(0, "src").alias("id")).distinct(), works.select(of(0, "src").alias("a"), of(1, "dst").alias("b")), most_nodes, most_links)
        out = two_steps(two_kinds, two_kinds.numbered.filter("id.kind = 0").select("id")).select("id.id", "mate.id").toDF("id", "mate")
    except TooLarge:
        out = mates(graph, work_type)
    if not explicit:
        return out
    tied = graph.of_type(*explicit).select(F.col("src").alias("id"), F.col("dst").alias("mate")).filter("id <> mate")
    tied = tied.unionByName(tied.select(F.col("mate").alias("id"), F.col("id").alias("mate"))).distinct()
    first, second = (works.select(F.col("src").alias(x), F.col("dst").alias(f"{x}_work")) for x in ("x", "y"))
    both = tied.join(first, F.col("id") == F.col("x")).join(second, (F.col("mate") == F.col("y")) & (F.col("x_work") == F.col("y_work"))).select("id", "mate").distinct()
    return out.unionByName(tied.join(both, ["id", "mate"], "left_anti"))
