"""Crawling as a dataflow, and nodes and edges derived from attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.names import split_list, title_key
from quern.iterate import settled

#: Fixed values: (what, pattern over a link's title, worth) of the rules that score a link.
LINK_RULES = [("keyword", "music|song|album|the", 8.0), ("title", "\\(band\\)|\\(group\\)", 10.0), ("company", "entertainment|records", -50.0), ("excluded", "film|list of", -20.0), ("korean", "[가-힣]", 4.0)]


def link_score(title: Column, depth: Column) -> Column:
    """Sum of the rules that match, half a point less a level, four less for titles of over 60 characters."""
    total = -0.5 * depth + F.when(F.length(title) > 60, -4.0).otherwise(0.0)
    for _, pattern, worth in LINK_RULES:
        total = total + F.when(F.lower(title).rlike(pattern), worth).otherwise(0.0)
    return total


def crawl(links: DataFrame, seeds: DataFrame, per_node: int = 10, most: int = 1000, depth: int = 4) -> DataFrame:
    """(id, depth): nodes taken level by level: the best ``per_node`` links of each node, best scores first until ``most`` are taken.

    ``links`` is (src, dst). Within a level the order is that of the scores; a strict best-first order over all levels would
    be one sequential queue.
    """
    seen = settled(seeds.select("id", F.lit(0).alias("depth")))
    level, n = seen, seen.count()
    for k in range(1, depth + 1):
        at = level.join(links.distinct(), F.col("id") == F.col("src")).select("src", "dst", link_score(F.col("dst"), F.lit(k)).alias("score"))
        w = Window.partitionBy("src").orderBy(F.desc("score"), "dst")
        best = at.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= per_node).groupBy(F.col("dst").alias("id")).agg(F.max("score").alias("score"))
        level = settled(best.join(seen.select("id"), "id", "left_anti").orderBy(F.desc("score"), "id").limit(max(0, most - n)).select("id", F.lit(k).alias("depth")))
        if not (new := level.count()):
            break
        n += new
        seen = seen.unionByName(level)
    return seen


def label_of(fields: DataFrame, rules: list[tuple[str, str, str, float]], labels: list[str]) -> DataFrame:
    """(id, label, score): additive evidence: rules (field, pattern, label, weight) over rows (id, field, value); equal scores go by the order of ``labels``."""
    table = fields.sparkSession.createDataFrame([(f, p, x, w, labels.index(x)) for f, p, x, w in rules], "f string, pattern string, label string, weight double, place int")
    hit = fields.join(F.broadcast(table), (F.col("field") == F.col("f")) & F.expr("regexp_like(lower(value), pattern)"))
    total = hit.groupBy("id", "label", "place").agg(F.sum("weight").alias("score"))
    best = F.max_by(F.struct("label", "score"), F.struct("score", -F.col("place")))
    return total.groupBy("id").agg(best.alias("b")).select("id", "b.label", "b.score")


def relevance(fields: DataFrame, rules: list[tuple[str, str, float, bool]]) -> DataFrame:
    """(id, score): the sum of the rules (field, pattern, weight, reject) that match; 0 if one rejects."""
    table = fields.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(rules)], "rule int, f string, pattern string, weight double, reject boolean")
    hit = fields.join(F.broadcast(table), (F.col("field") == F.col("f")) & F.expr("regexp_like(lower(value), pattern)"))
    once = hit.select("id", "rule", "weight", "reject").distinct()
    got = once.groupBy("id").agg(F.sum("weight").alias("sum"), F.max("reject").alias("out"))
    return fields.select("id").distinct().join(got, "id", "left").select("id", F.when(F.coalesce("out", F.lit(False)), 0.0).otherwise(F.coalesce("sum", F.lit(0.0))).alias("score"))


def duplicates(pages: DataFrame, key: Column) -> DataFrame:
    """(id, kept): pages of one signature are kept as the first id."""
    first = pages.groupBy(F.sha2(key, 256).alias("signature")).agg(F.min("id").alias("kept"))
    return pages.select("id", F.sha2(key, 256).alias("s")).join(first, F.col("s") == F.col("signature")).select("id", "kept")


def derived_nodes(rows: DataFrame, field: str, label: str, normal=lambda c: c) -> DataFrame:
    """(id, label, title) of the distinct items of a list-valued field."""
    item = rows.select(F.explode(split_list(F.col(field))).alias("x")).select(normal(F.col("x")).alias("title")).filter("title IS NOT NULL AND title <> ''").distinct()
    return item.select(F.concat(F.lit(label + "_"), "title").alias("id"), F.lit(label).alias("label"), "title")


def edges_from_lists(rows: DataFrame, fields: list[str], targets: DataFrame, rel_type: str) -> DataFrame:
    """(src, dst, rel_type): items of the first of ``fields`` that is not empty, matched to targets (id, title) by title key; the last id of a key wins."""
    value = F.coalesce(*[F.nullif(F.trim(f), F.lit("")) for f in fields])
    items = rows.select(F.col("id").alias("src"), F.explode(split_list(value)).alias("item")).withColumn("k", title_key(F.col("item")))
    of = targets.groupBy(title_key(F.col("title")).alias("key")).agg(F.max("id").alias("dst"))
    return items.join(of, F.col("k") == F.col("key")).select("src", "dst", F.lit(rel_type).alias("rel_type"))


def sub_units(groups: DataFrame) -> DataFrame:
    """(src, dst): groups (id, title) whose title goes on after another's with a space, ``-``, ``_`` or ``(``. Prefixes at such places
    are looked up by an equi-join."""
    t = F.lower("title")
    cuts = F.filter(F.sequence(F.lit(2), F.greatest(F.length(t), F.lit(2))), lambda i: F.substr(t, i, F.lit(1)).isin(" ", "-", "_", "("))
    child = groups.select(F.col("id").alias("src"), t.alias("t"), F.explode(cuts).alias("i")).withColumn("prefix", F.substr("t", F.lit(1), F.col("i") - 1))
    return child.join(groups.select(F.col("id").alias("dst"), t.alias("parent")), F.col("prefix") == F.col("parent")).filter("src <> dst").select("src", "dst").distinct()


def typed_links(links: DataFrame, nodes: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(src, dst, rel_type): links between nodes typed by their labels, rules (src_label, dst_label, rel_type); other label pairs are not allowed and go."""
    table = links.sparkSession.createDataFrame(rules, "a string, b string, rel_type string")
    of = lambda x: nodes.select(F.col("id").alias(f"{x}_id"), F.col("label").alias(f"{x}_label"))
    at = links.join(of("s"), F.col("src") == F.col("s_id")).join(of("d"), F.col("dst") == F.col("d_id"))
    return at.join(F.broadcast(table), (F.col("s_label") == F.col("a")) & (F.col("d_label") == F.col("b"))).select("src", "dst", "rel_type")


def evidenced_links(links: DataFrame, nodes: DataFrame, rules: list[tuple[str, str, str, str, str]]) -> DataFrame:
    """(src, dst, rel_type): links typed by their labels where an infobox bears them out.

    A rule is (src_label, dst_label, side, field, rel_type): the other end's title stands in that field of the ``side``'s (src or
    dst) infobox. ``nodes`` have id, label, title and infobox, a map.
    """
    table = links.sparkSession.createDataFrame(rules, "a string, b string, side string, field string, rel_type string")
    of = lambda x: nodes.select(F.col("id").alias(f"{x}_id"), F.col("label").alias(f"{x}_label"), title_key(F.col("title")).alias(f"{x}_key"), F.col("infobox").alias(f"{x}_box"))
    at = links.select("src", "dst").join(of("s"), F.col("src") == F.col("s_id")).join(of("d"), F.col("dst") == F.col("d_id"))
    at = at.join(F.broadcast(table), (F.col("s_label") == F.col("a")) & (F.col("d_label") == F.col("b")))  # a rule table of fixed size
    shown = F.when(F.col("side") == "src", F.contains(F.lower(F.col("s_box")[F.col("field")]), F.col("d_key"))).otherwise(F.contains(F.lower(F.col("d_box")[F.col("field")]), F.col("s_key")))
    return at.filter(shown).select("src", "dst", "rel_type").distinct()


def word_members(artists: DataFrame, groups: DataFrame, field: str) -> DataFrame:
    """(src, dst): artists (id, title) whose title stands in a group's member field as whole words: runs of words, as long as the
    longest title, meet the titles by an equi-join."""
    longest = artists.agg(F.max(F.size(F.filter(F.split(title_key(F.col("title")), r"[^\p{L}\p{N}]+"), lambda x: x != "")))).first()[0] or 1
    w = F.filter(F.split(F.lower(F.col(field)), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1))), lambda i: F.array_join(F.slice("w", i, n), " "))))
    spots = groups.select(F.col("id").alias("dst"), w.alias("w")).select("dst", F.explode(F.array_distinct(runs)).alias("run"))
    key = F.array_join(F.filter(F.split(title_key(F.col("title")), r"[^\p{L}\p{N}]+"), lambda x: x != ""), " ")
    return artists.select(F.col("id").alias("src"), key.alias("key")).join(spots, F.col("key") == F.col("run")).select("src", "dst").distinct()


#: What a link's title may not have, and what a page's text must have.
EXCLUDED = r"^(file|category|template|help|wikipedia|special):|list of|\(film\)|discography"
RELEVANT = r"k-pop|korea|band|singer|album|song"


def excluded(title: Column, pattern: str = EXCLUDED) -> Column:
    return F.lower(title).rlike(pattern)


def relevant(text: Column, pattern: str = RELEVANT) -> Column:
    return F.lower(text).rlike(pattern)


def resolved_links(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (src, dst) both of whose ends were taken, whatever the order they were taken in."""
    ids = nodes.select("id")
    return links.distinct().join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")
