"""Queries over evidence, roles, tagged entities, descriptions and names as ends of paths."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from quern.functions import names as N
from quern.graph import trade
from quern.operators import evidence as V
from quern.operators import extraction as X
from quern.operators import paths as P
from quern.plans.registry import Registry
from quern.sources import pages

r = Registry()


def t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


#: Words that stand for entities, and what bears out their relations.
TYPES = {"thing": "Artist", "that": "Artist", "for": "Group", "ou": "Group", "the": "Album"}
SHOWN = {"MEMBER_OF": V.Evidence(("Artist",), ("Group",), 40, (r"{s}\s+\S+\s+\S+\s+{t}",), ("the",)), "RELEASED": V.Evidence(("Artist", "Group"), ("Album",), 15, (), ("de",))}


@r.query("x4_directed")
def _(spark, d):
    docs = t(spark, d, "documents")
    spans = X.tokens(docs).filter(F.col("word").isin(*TYPES)).select("doc_id", "start", F.col("word").alias("name"))
    kinds = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    pairs = V.pairs_in_context(docs, spans.withColumn("type", kinds[F.col("name")]), max(e.far for e in SHOWN.values()))
    rows = pairs.withColumn("rel_type", F.when(F.col("dst_type") == "Group", "MEMBER_OF").otherwise("RELEASED"))
    return V.directed(rows, SHOWN).select("doc_id", "src", "rel_type", "dst").distinct()


@r.query("j8_by_occupation", "SELECT DISTINCT 'producer' AS role, lower(c_name) AS name FROM customer WHERE regexp_matches(lower(c_mktsegment), 'machine|build') UNION SELECT DISTINCT 'writer', lower(c_name) FROM customer WHERE contains(lower(c_mktsegment), 'furniture') UNION SELECT 'producer', 'teddy'")
def _(spark, d):
    people = t(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("occupation"))
    return V.by_occupation(people, {"producer": ["machine", "build"], "writer": ["furniture"]}, {"producer": ["Teddy"]})


def capitalised(parts: list[str]) -> list[list[tuple[str, str, float]]]:
    """Stands in for a model: capitalised words as people, capitals as organisations."""
    label = lambda w: "PER" if re.fullmatch("[A-Z][a-z]{3,30}", w) else "ORG" if re.fullmatch("[A-Z]{3,20}", w) else ""
    return [[(w, label(w), 0.9) for w in p.split(" ") if label(w)] for p in parts]


@r.query("t10_tagged", "SELECT DISTINCT doc_id, CASE WHEN regexp_full_match(w, '[A-Z]{3,20}') THEN CASE WHEN regexp_matches(lower(w), 'entertainment|music|media|label|agency') THEN 'Company' ELSE 'Group' END ELSE 'Artist' END AS type, w AS text, 0.81::DOUBLE AS confidence FROM (SELECT doc_id, unnest(split(text, ' ')) AS w FROM documents) WHERE regexp_full_match(w, '[A-Z][a-z]{3,30}|[A-Z]{3,20}')")
def _(spark, d):
    return V.tagged(t(spark, d, "documents"), capitalised).withColumn("confidence", F.round("confidence", 6))


@r.query("s6_descriptions", "SELECT p_partkey AS page_id, 'Album của ' || p_name || ' và ' || p_brand || ' từ album ' || p_type AS description, p_name || ', ' || p_brand || ', ' || p_type AS performed_by, p_name || ', ' || p_brand || ', ' || p_type AS album FROM part")
def _(spark, d):
    link = lambda c: F.concat(F.lit('<a href="/x">'), c, F.lit("</a>"))
    html = F.concat(F.lit('<table class="infobox"><tr><th class="infobox-header description">Album của '), link("p_name"), F.lit(" và\n"), link("p_brand"), F.lit(" từ album "), link("p_type"), F.lit("</th></tr></table>"))
    return pages.descriptions(t(spark, d, "part").select(F.col("p_partkey").alias("page_id"), html.alias("html")))


@r.query("n13_node_text", "SELECT 'Part_' || p_partkey AS id, 'Part_' || p_partkey || ' | loại: Part | ' || p_name || ' | Thể loại: ' || p_type || CASE WHEN p_size > 25 THEN ' | Hãng đĩa: ' || p_brand ELSE '' END AS text FROM part")
def _(spark, d):
    key = F.concat(F.lit("Part_"), "p_partkey")
    box = F.create_map(F.lit("Thể loại"), "p_type", F.lit("Hãng đĩa"), F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise(""), F.lit("other"), "p_name")
    return t(spark, d, "part").select(key.alias("id"), N.node_text(key, F.lit("Part"), F.col("p_name"), box).alias("text"))


@r.query("p7_path_by_name", "SELECT 'Nation_' || n_nationkey AS src, 'Region_' || n_regionkey AS dst, 1 AS hops, 'Nation_' || n_nationkey || ' > Region_' || n_regionkey AS path FROM nation")
def _(spark, d):
    whole = trade(spark, d)
    names = t(spark, d, "nation").join(F.broadcast(t(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select(F.upper("n_name").alias("src_name"), F.lower("r_name").alias("dst_name"))
    pairs = P.named_pairs(whole.nodes.filter("label IN ('Nation', 'Region')"), names)
    edges = whole.edges.filter("rel_type = 'MANAGED_BY'")
    return P.shortest_paths(P.both_ways(edges.select("src", "dst")), pairs, 10).withColumn("path", F.array_join("path", " > "))
