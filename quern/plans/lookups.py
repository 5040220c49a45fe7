"""Queries over look-ups, reasoning joins and set operations of the trade graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.graph import TRADE_SQL, trade
from quern.operators import lookups as K
from quern.operators import reasoning as Q
from quern.plans.registry import Registry

r = Registry("WITH " + TRADE_SQL)


@r.query("k1_resolve_ids", """,
names AS (SELECT title AS name FROM nodes WHERE label IN ('Brand', 'Type') UNION SELECT upper(id) FROM nodes WHERE label = 'Region' UNION SELECT id FROM nodes WHERE label = 'Nation' UNION SELECT 'nothing'),
keyed AS (SELECT id, regexp_replace(id, '^(Customer|Supplier|Nation|Region|Order|Part|Brand|Type)_', '') AS short FROM nodes),
s AS (SELECT short, min(id) AS id FROM keyed GROUP BY 1),
l AS (SELECT k, min(id) AS id FROM (SELECT lower(id) AS k, id FROM keyed UNION ALL SELECT lower(short), id FROM keyed) GROUP BY 1)
SELECT name, coalesce(n.id, s.id, l.id) AS id FROM names LEFT JOIN nodes n ON name = n.id LEFT JOIN s ON name = s.short LEFT JOIN l ON lower(name) = l.k""")
def _(spark, d):
    g = trade(spark, d)
    names = g.nodes.filter("label IN ('Brand', 'Type')").select(F.col("title").alias("name"))
    names = names.union(g.nodes.filter("label = 'Region'").select(F.upper("id"))).union(g.nodes.filter("label = 'Nation'").select("id")).union(spark.sql("SELECT 'nothing'"))
    return K.resolve(g, names)


@r.query("k2_entities_by_type", "SELECT id, title FROM nodes WHERE label = 'Supplier'")
def _(spark, d):
    return K.of_label(trade(spark, d), "Supplier")


@r.query("k3_neighbours", "SELECT * FROM both_ways WHERE id IN ('Nation_3', 'Part_5', 'Region_1')")
def _(spark, d):
    g = trade(spark, d)
    return K.neighbours(g, g.nodes.filter(F.col("id").isin("Nation_3", "Part_5", "Region_1")))


@r.query("k4_relationships", """SELECT src, s.label AS src_label, rel_type, dst, t.label AS dst_label
FROM edges JOIN nodes s ON src = s.id JOIN nodes t ON dst = t.id WHERE src IN ('Nation_7', 'Part_9') OR dst IN ('Nation_7', 'Part_9')""")
def _(spark, d):
    g = trade(spark, d)
    return K.relationships(g, g.nodes.filter(F.col("id").isin("Nation_7", "Part_9")))


@r.query("k5_search", """SELECT id, title, CASE WHEN lower(title) = 'red widget' THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END AS score
FROM nodes WHERE contains(lower(title), 'red widget') ORDER BY score DESC, id LIMIT 10""")
def _(spark, d):
    return K.search(trade(spark, d), "Red Widget")


@r.query("k6_induced_subgraph", """SELECT src, dst, rel_type FROM edges
WHERE src IN (SELECT id FROM nodes WHERE label IN ('Nation', 'Region', 'Supplier')) AND dst IN (SELECT id FROM nodes WHERE label IN ('Nation', 'Region', 'Supplier'))""")
def _(spark, d):
    g = trade(spark, d)
    return K.subgraph(g, g.nodes.filter("label IN ('Nation', 'Region', 'Supplier')")).edges


@r.query("k7_group_members", """SELECT dst AS "group", src AS member FROM edges JOIN nodes ON src = id WHERE rel_type = 'MEMBER_OF' AND label = 'Customer'""")
def _(spark, d):
    return K.members(trade(spark, d))


@r.query("k8_linked_both_ways", """SELECT DISTINCT b.id, b.nbr AS other FROM both_ways b JOIN nodes x ON b.id = x.id JOIN nodes y ON b.nbr = y.id
WHERE rel_type IN ('SUPPLIES', 'CONTAINS') AND x.label = 'Part' AND y.label = 'Supplier'""")
def _(spark, d):
    return K.linked(trade(spark, d), "Part", "Supplier", "SUPPLIES", "CONTAINS")


@r.query("k9_companies_of_groups", """SELECT DISTINCT b.id, b.nbr AS other FROM both_ways b JOIN nodes x ON b.id = x.id JOIN nodes y ON b.nbr = y.id
WHERE rel_type = 'MANAGED_BY' AND x.label = 'Region' AND y.label = 'Nation'""")
def _(spark, d):
    return K.linked(trade(spark, d), "Region", "Nation", "MANAGED_BY")


@r.query("k10_statistics", """SELECT n AS n_nodes, m AS n_edges, n_types, round(2 * m / n, 6) AS mean_degree, round(m / (n::DOUBLE * (n - 1)), 12) AS density
FROM (SELECT count(*) AS n FROM nodes), (SELECT count(*) AS m, count(DISTINCT rel_type) AS n_types FROM edges)""")
def _(spark, d):
    return K.statistics(trade(spark, d))


@r.query("k11_entity_context", """,
h1 AS (SELECT nbr AS id, min(rel_type) AS rel_type FROM both_ways WHERE id = 'Customer_5' GROUP BY 1),
h2 AS (SELECT b.nbr AS id, min(b.rel_type) AS rel_type FROM h1 JOIN both_ways b ON b.id = h1.id WHERE b.nbr NOT IN (SELECT id FROM h1) AND b.nbr <> 'Customer_5' GROUP BY 1)
SELECT 'Customer_5' AS start, 'Customer_5' AS id, 0 AS hops, CAST(NULL AS VARCHAR) AS rel_type
UNION ALL SELECT 'Customer_5', id, 1, rel_type FROM h1 UNION ALL SELECT 'Customer_5', id, 2, rel_type FROM h2""")
def _(spark, d):
    g = trade(spark, d)
    return K.context(g, g.nodes.filter("id = 'Customer_5'"))


@r.query("k12_membership", """,
pairs AS (SELECT a.id AS src, b.id AS dst FROM nodes a, nodes b WHERE a.label = 'Supplier' AND b.label = 'Nation')
SELECT src, dst, EXISTS (SELECT 1 FROM edges e WHERE e.src = pairs.src AND e.dst = pairs.dst AND e.rel_type = 'MEMBER_OF') AS linked FROM pairs""")
def _(spark, d):
    g = trade(spark, d)
    nations = F.broadcast(g.nodes.filter("label = 'Nation'").select(F.col("id").alias("dst")))
    return K.is_member(g, g.nodes.filter("label = 'Supplier'").select(F.col("id").alias("src")).join(nations), "MEMBER_OF")


@r.query("q1_chain", """SELECT DISTINCT e1.src AS start, e3.dst AS answer FROM edges e1 JOIN edges e2 ON e1.dst = e2.src JOIN edges e3 ON e2.dst = e3.src
WHERE e1.rel_type = 'PLACED' AND e2.rel_type = 'CONTAINS' AND e3.rel_type = 'IS_GENRE' AND starts_with(e3.dst, 'Type_')""")
def _(spark, d):
    g = trade(spark, d)
    return Q.chain(g, g.nodes.filter("label = 'Customer'"), ["PLACED", "CONTAINS", "IS_GENRE"], "Type")


@r.query("q2_count_in_ball", """,
h1 AS (SELECT DISTINCT nbr AS id FROM both_ways WHERE id = 'Nation_4'),
h2 AS (SELECT DISTINCT b.nbr AS id FROM h1 JOIN both_ways b ON b.id = h1.id),
ball AS (SELECT id FROM h1 UNION SELECT id FROM h2)
SELECT 'Nation_4' AS start, label, count(*) AS n FROM ball JOIN nodes USING (id) WHERE id <> 'Nation_4' GROUP BY 2""")
def _(spark, d):
    g = trade(spark, d)
    return Q.count_in_ball(g, g.nodes.filter("id = 'Nation_4'"), 2)


@r.query("q3_comparison", """,
a AS (SELECT DISTINCT rel_type, nbr FROM both_ways WHERE id = 'Part_11'), b AS (SELECT DISTINCT rel_type, nbr FROM both_ways WHERE id = 'Part_12')
SELECT 'both' AS side, rel_type, nbr FROM (FROM a INTERSECT FROM b) UNION ALL SELECT 'first', rel_type, nbr FROM (FROM a EXCEPT FROM b) UNION ALL SELECT 'second', rel_type, nbr FROM (FROM b EXCEPT FROM a)""")
def _(spark, d):
    return Q.compare(trade(spark, d), "Part_11", "Part_12")


@r.query("q4_common_neighbours", """SELECT nbr AS id FROM both_ways WHERE id IN ('Supplier_1', 'Supplier_2') GROUP BY nbr HAVING count(DISTINCT id) = 2""")
def _(spark, d):
    return Q.common_neighbours(trade(spark, d), ["Supplier_1", "Supplier_2"])


@r.query("q5_confidence", """,
h AS (SELECT unnest([1, 2, 3, 4, 5]) AS hops)
SELECT hops, round(power(0.9, least(hops, 2)) * power(0.8, greatest(hops - 2, 0)), 9) AS confidence FROM h""")
def _(spark, d):
    return spark.range(1, 6).select(F.col("id").cast("int").alias("hops")).withColumn("confidence", F.round(Q.confidence(F.col("hops")), 9))


@r.query("q6_same_company", """SELECT a.src AS a, b.src AS b, a.dst AS via FROM edges a JOIN edges b ON a.dst = b.dst AND a.src < b.src WHERE a.rel_type = 'MANAGED_BY' AND b.rel_type = 'MANAGED_BY'""")
def _(spark, d):
    return Q.sharing(trade(spark, d), "MANAGED_BY")


@r.query("q7_same_company_via_group", """,
c AS (SELECT m.src, r.dst FROM edges m JOIN edges r ON m.dst = r.src JOIN nodes ON m.src = id WHERE m.rel_type = 'MEMBER_OF' AND r.rel_type = 'MANAGED_BY' AND label = 'Supplier')
SELECT DISTINCT a.src AS a, b.src AS b, a.dst AS via FROM c a JOIN c b ON a.dst = b.dst AND a.src < b.src""")
def _(spark, d):
    g = trade(spark, d)
    suppliers = g.nodes.filter("label = 'Supplier'")
    return Q.sharing_via(g, suppliers, "MEMBER_OF", "MANAGED_BY")


@r.query("q8_labelmates", """SELECT DISTINCT a.src AS id, b.src AS mate FROM edges a JOIN edges b ON a.dst = b.dst AND a.src <> b.src WHERE a.rel_type = 'MANAGED_BY' AND b.rel_type = 'MANAGED_BY'""")
def _(spark, d):
    return Q.mates(trade(spark, d), "MANAGED_BY")


@r.query("q9_single_hop", """SELECT src AS id, dst AS answer FROM edges WHERE rel_type = 'IS_GENRE' AND starts_with(dst, 'Brand_')""")
def _(spark, d):
    g = trade(spark, d)
    return Q.getter(g, "IS_GENRE", "Brand")


@r.query("q10_customer_regions", """SELECT DISTINCT m.src AS id, r.dst AS answer FROM edges m JOIN edges r ON m.dst = r.src JOIN nodes ON m.src = id
WHERE m.rel_type = 'MEMBER_OF' AND r.rel_type = 'MANAGED_BY' AND label = 'Customer'""")
def _(spark, d):
    g = trade(spark, d)
    return Q.direct_or_via(g, g.nodes.filter("label = 'Customer'"), "MANAGED_BY", "MEMBER_OF")


@r.query("q11_chain_reversed", """SELECT DISTINCT o.dst AS start, r.dst AS answer FROM edges o JOIN edges m ON o.src = m.src JOIN edges r ON m.dst = r.src
WHERE o.rel_type = 'PLACED' AND m.rel_type = 'MEMBER_OF' AND r.rel_type = 'MANAGED_BY'""")
def _(spark, d):
    g = trade(spark, d)
    return Q.chain(g, g.nodes.filter("label = 'Order'"), ["<PLACED", "MEMBER_OF", "MANAGED_BY"], "Region")


@r.query("q15_all_in_company", """,
c AS (SELECT m.dst AS "group", count(*) AS n, count(*) FILTER (c_acctbal > 0) AS yes FROM edges m JOIN customer ON m.src = 'Customer_' || c_custkey WHERE rel_type = 'MEMBER_OF' GROUP BY 1)
SELECT "group", yes = n AS all_hold, yes > 0 AS any_hold FROM c""")
def _(spark, d):
    rich = spark.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("Customer_"), F.col("c_custkey")).alias("id"), (F.col("c_acctbal") > 0).alias("holds"))
    return Q.quantified(trade(spark, d), "MEMBER_OF", rich)
