"""Queries over paths and network analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.graph import ROUTES_SQL, SIMILARITY_SQL, TRADE_SQL, routes, similarity, trade
from quern.operators import analytics as A
from quern.operators import paths as P
from quern.packed import hops, packed
from quern.plans.registry import Registry

r = Registry("WITH RECURSIVE " + TRADE_SQL)
v = Registry("WITH RECURSIVE " + SIMILARITY_SQL)
w = Registry("WITH RECURSIVE " + ROUTES_SQL)


def near(spark, d):
    g = similarity(spark, d)
    return g, g.edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))


ball = """,
walk AS (SELECT id AS source, id, 0 AS hops FROM verts WHERE {start} UNION SELECT source, nbr, hops + 1 FROM walk JOIN adj USING (id) WHERE hops < {most}),
dist AS (SELECT source, id, min(hops) AS hops FROM walk GROUP BY 1, 2)
"""


@v.query("p1_hops", ball.format(start="true", most=40) + "SELECT * FROM dist")
def _(spark, d):
    g, p = near(spark, d)
    return hops(packed(g.nodes, p))


@r.query("p2_directed_shortest", """,
walk AS (SELECT src, dst AS pos, 1 AS hops, [src, dst] AS path FROM edges WHERE starts_with(src, 'Customer_') UNION ALL
  SELECT walk.src, e.dst, hops + 1, list_append(path, e.dst) FROM walk JOIN edges e ON pos = e.src WHERE hops < 5)
SELECT src, pos AS dst, min(hops) AS hops, arg_min(path, (hops, path)) AS path FROM walk WHERE starts_with(pos, 'Type_') OR starts_with(pos, 'Region_') GROUP BY src, pos""")
def _(spark, d):
    """From every customer; the pairs asked for are those that can be reached."""
    g = trade(spark, d)
    starts = g.nodes.filter("label = 'Customer'")
    ends = g.nodes.filter("label IN ('Type', 'Region')").select(F.col("id").alias("dst"))
    reach = P.hops(g.edges.select("src", "dst"), starts, 5).select(F.col("source").alias("src"), F.col("id").alias("dst"))
    return P.shortest_paths(g.edges, reach.join(ends, "dst", "left_semi").select("src", "dst"), 5)


simple = """,
walk AS (SELECT id AS src, id AS dst, 0 AS hops, [id] AS path FROM verts UNION ALL
  SELECT src, nbr, hops + 1, list_append(path, nbr) FROM walk JOIN adj ON walk.dst = adj.id WHERE hops < 3 AND NOT list_contains(path, nbr))
"""


@v.query("p3_simple_paths", simple + "SELECT src, dst, hops, path FROM walk WHERE hops > 0")
def _(spark, d):
    g = similarity(spark, d)
    return P.simple_paths(P.both_ways(g.edges.select("src", "dst")), g.nodes, few=P.FEW)


@r.query("p4_path_details", """,
p AS (SELECT [m.src, m.dst, g.dst] AS path FROM edges m JOIN edges g ON m.dst = g.src WHERE starts_with(m.src, 'Customer_') AND m.rel_type = 'MEMBER_OF'),
s AS (SELECT path, unnest(range(len(path) - 1)) AS step FROM p)
SELECT path, CAST(step AS INTEGER) AS step, path[step + 1] AS src, path[step + 2] AS dst, rel_type FROM s JOIN edges e ON e.src = path[step + 1] AND e.dst = path[step + 2]""")
def _(spark, d):
    g = trade(spark, d)
    return P.details(P.simple_paths(g.of_type("MEMBER_OF", "MANAGED_BY"), g.nodes.filter("label = 'Customer'"), 2).filter("hops = 2"), g.edges)


@v.query("p5_undirected_shortest", """,
walk AS (SELECT id AS src, id AS pos, 0 AS hops FROM verts UNION SELECT src, nbr, hops + 1 FROM walk JOIN adj ON pos = adj.id WHERE hops < 10)
SELECT src, pos AS dst, min(hops) AS hops FROM walk WHERE pos <> src GROUP BY 1, 2""")
def _(spark, d):
    g, p = near(spark, d)
    return hops(packed(g.nodes, p), 10).filter("hops > 0").select(F.col("source").alias("src"), F.col("id").alias("dst"), "hops")


@v.query("p6_all_shortest_paths")
def _(spark, d):
    g = similarity(spark, d)
    near_ = P.both_ways(g.edges.select("src", "dst"))
    reach = P.hops(near_, g.nodes, 10).filter("hops > 0").select(F.col("source").alias("src"), F.col("id").alias("dst"))
    return P.shortest_paths(near_, reach, 10, every=True)


@r.query("p8_projection", """SELECT DISTINCT x AS src, y AS dst, rel_type FROM (SELECT src AS x, dst AS y, rel_type FROM edges UNION ALL SELECT dst, src, rel_type FROM edges)
WHERE rel_type IN ('MEMBER_OF', 'MANAGED_BY') AND x IN (SELECT id FROM nodes WHERE label IN ('Supplier', 'Nation')) AND y IN (SELECT id FROM nodes WHERE label IN ('Supplier', 'Nation'))""")
def _(spark, d):
    return trade(spark, d).typed(["Supplier", "Nation"], ["MEMBER_OF", "MANAGED_BY"], undirected=True).edges.select("src", "dst", "rel_type")


@w.query("p9_least_cost", """,
cut AS (SELECT src, dst, 1000.0 / weight AS weight FROM routes),
walk AS (SELECT src AS source, src AS id, 0::DOUBLE AS cost, 0 AS k FROM (SELECT DISTINCT src FROM cut) UNION ALL
  SELECT source, id, min(cost), k FROM (SELECT w.source, c.dst AS id, w.cost + c.weight AS cost, w.k + 1 AS k FROM walk w JOIN cut c ON w.id = c.src WHERE w.k < 6) GROUP BY 1, 2, 4)
SELECT source, id, round(min(cost), 6) AS cost FROM walk GROUP BY 1, 2""")
def _(spark, d):
    e = routes(spark, d).select("src", "dst", (F.lit(1000.0) / F.col("weight")).alias("weight"))
    return P.distances(e, e.select(F.col("src").alias("id"))).withColumn("cost", F.round("cost", 6))


@w.query("p10_k_cheapest", """,
cut AS (SELECT src, dst, 1000.0::DOUBLE / weight AS weight FROM routes WHERE src <> dst),
walk AS (SELECT src, src AS pos, [src] AS path, 0::DOUBLE AS cost FROM (VALUES (CAST(1 AS BIGINT)), (2)) t(src) UNION ALL
  SELECT walk.src, dst, list_append(path, dst), cost + weight FROM walk JOIN cut ON pos = cut.src WHERE len(path) < 4 AND NOT list_contains(path, dst) AND pos <> 7)
SELECT src, pos AS dst, CAST(row_number() OVER (PARTITION BY src ORDER BY cost, path) AS INTEGER) AS rank, round(cost, 6) AS cost, path FROM walk WHERE pos = 7 QUALIFY rank <= 3""")
def _(spark, d):
    e = routes(spark, d).filter("src <> dst").select("src", "dst", (F.lit(1000.0) / F.col("weight")).alias("weight"))
    return P.k_shortest(e, spark.createDataFrame([(1, 7), (2, 7)], "src long, dst long")).withColumn("cost", F.round("cost", 6))


@r.query("p12_two_hops", """SELECT a.src AS start, a.rel_type AS rel1, a.dst AS mid, b.rel_type AS rel2, b.dst AS "end", 'forward' AS shape FROM edges a JOIN edges b ON a.dst = b.src WHERE a.src <> b.dst AND a.rel_type IN ('MEMBER_OF', 'MANAGED_BY') AND b.rel_type IN ('MEMBER_OF', 'MANAGED_BY')
UNION ALL SELECT a.src, a.rel_type, a.dst, b.rel_type, b.src, 'reverse' FROM edges a JOIN edges b ON a.dst = b.dst WHERE a.src <> b.src AND a.rel_type IN ('MEMBER_OF', 'MANAGED_BY') AND b.rel_type IN ('MEMBER_OF', 'MANAGED_BY')""")
def _(spark, d):
    return P.two_hops(trade(spark, d).of_type("MEMBER_OF", "MANAGED_BY"), P.FEW)


@r.query("p13_three_hops", """SELECT a.src AS start, a.rel_type AS rel1, a.dst AS mid1, b.rel_type AS rel2, b.dst AS mid2, c.rel_type AS rel3, c.dst AS "end"
FROM edges a JOIN edges b ON a.dst = b.src JOIN edges c ON b.dst = c.src WHERE a.src <> b.dst AND c.dst <> a.src AND c.dst <> a.dst""")
def _(spark, d):
    return P.three_hops(trade(spark, d).edges)


@r.query("p14_path_scores", """,
p AS (SELECT a.src AS start, a.rel_type AS rel1, a.dst AS mid, b.rel_type AS rel2, b.dst AS "end" FROM edges a JOIN edges b ON a.dst = b.src WHERE a.src <> b.dst)
SELECT start, rel1, mid, rel2, "end", 'forward' AS shape, CASE WHEN rel1 = 'MEMBER_OF' AND rel2 = 'MANAGED_BY' THEN 10::DOUBLE WHEN rel1 = 'CONTAINS' AND rel2 = 'IS_GENRE' THEN 8 WHEN rel1 = 'SUPPLIES' AND rel2 = 'IS_GENRE' THEN 7 WHEN rel1 = 'PLACED' AND rel2 = 'CONTAINS' THEN 6 ELSE 1 END AS score FROM p""")
def _(spark, d):
    return P.scored(P.two_hops(trade(spark, d).edges).filter("shape = 'forward'"))


comp = ball.format(start="true", most=40) + ", comp AS (SELECT source AS id, min(id) AS component FROM dist GROUP BY 1), "
lcc = comp + "top AS (SELECT component FROM comp GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1), own AS (SELECT id FROM comp JOIN top USING (component)) "
deg = ", deg AS (SELECT v.id, count(nbr) AS degree FROM verts v LEFT JOIN adj USING (id) GROUP BY 1)"
tri = """, tri AS (SELECT p.a AS x, p.b AS y, q.b AS z FROM pairs p JOIN pairs q ON p.b = q.a JOIN pairs s ON s.a = p.a AND s.b = q.b)"""
clus = deg + tri + """, clus AS (SELECT id, CASE WHEN degree < 2 THEN 0 ELSE 2.0::DOUBLE * (SELECT count(*) FROM tri WHERE d.id IN (x, y, z)) / (degree * (degree - 1)) END AS clustering FROM deg d)"""


@v.query("a1_components", comp.rstrip(", ") + " SELECT * FROM comp")
def _(spark, d):
    g, p = near(spark, d)
    return A.components(g.nodes, p)


@v.query("a2_a4_path_lengths", lcc + "SELECT round(avg(hops), 9) AS mean_path, max(hops) AS diameter FROM dist WHERE hops > 0 AND source IN (FROM own)")
def _(spark, d):
    g, p = near(spark, d)
    return A.path_length_counts(g.nodes, p).agg(F.round(F.sum(F.col("hops") * F.col("n")) / F.sum("n"), 9).alias("mean_path"), F.max("hops").alias("diameter"))


@v.query("a3_clustering", clus + " SELECT id, round(clustering, 9) AS clustering FROM clus")
def _(spark, d):
    g, p = near(spark, d)
    return A.clustering(g.nodes, p).withColumn("clustering", F.round("clustering", 9))


@v.query("a5_small_world", clus + lcc + """, row_ AS (
  SELECT (SELECT count(*) FROM own) AS n, (SELECT count(*) FROM pairs WHERE a IN (FROM own) AND b IN (FROM own)) AS m, (SELECT avg(hops) FROM dist WHERE hops > 0 AND source IN (SELECT id FROM own)) AS mean_path,
         (SELECT max(hops) FROM dist WHERE source IN (SELECT id FROM own)) AS diameter, (SELECT avg(clustering) FROM clus) AS clustering),
x AS (SELECT *, 2 * m / n AS k FROM row_)
SELECT n, m, round(mean_path, 6) AS mean_path, diameter, round(clustering, 6) AS clustering, round((clustering / (k / n)) / (mean_path / (ln(n) / ln(k))), 6) AS sigma, mean_path < 2 * ln(n) AS short_paths, clustering > 10 * k / n AS clustered, mean_path < 2 * ln(n) AND clustering > 10 * k / n AS is_small_world FROM x""")
def _(spark, d):
    g, p = near(spark, d)
    row = A.small_world(g.nodes, p)
    return row.select("n", "m", F.round("mean_path", 6).alias("mean_path"), "diameter", F.round("clustering", 6).alias("clustering"), F.round("sigma", 6).alias("sigma"), "short_paths", "clustered", "is_small_world")


rank = deg + """, n AS (SELECT count(*)::DOUBLE AS n FROM verts),
pr AS (SELECT 0 AS k, id, 1 / n AS rank FROM verts, n UNION ALL
  SELECT k + 1, d.id, 0.15 / n.n + 0.85 * coalesce((SELECT sum(p.rank / e.degree) FROM pr p JOIN adj ON p.id = adj.id JOIN deg e ON e.id = p.id WHERE adj.nbr = d.id), 0)
    + 0.85 * (SELECT coalesce(sum(p.rank), 0) FROM pr p JOIN deg e USING (id) WHERE e.degree = 0) / n.n
  FROM deg d, n, (SELECT DISTINCT k FROM pr WHERE k < 20) s)"""


@v.query("a6_pagerank", rank + " SELECT id, round(rank, 9) AS rank FROM pr WHERE k = 20")
def _(spark, d):
    g, p = near(spark, d)
    return A.pagerank(g.nodes, p).withColumn("rank", F.round("rank", 9))


@v.query("a7_ranking", deg + " SELECT CAST(row_number() OVER (ORDER BY degree DESC, id) AS INTEGER) AS place, id, label, degree FROM deg JOIN verts USING (id) QUALIFY place <= 10")
def _(spark, d):
    g, p = near(spark, d)
    return A.ranking(A.degrees(g.nodes, p), g.nodes, "degree")


@v.query("a7_by_label", deg + " SELECT label, count(*) AS n, round(avg(degree), 9) AS mean, arg_min(id, (-degree, id)) AS top FROM deg JOIN verts USING (id) GROUP BY 1")
def _(spark, d):
    g, p = near(spark, d)
    return A.by_label(A.degrees(g.nodes, p), g.nodes, "degree").withColumn("mean", F.round("mean", 9))


@v.query("a8_degree_centrality", deg + " SELECT id, degree::DOUBLE / ((SELECT count(*) FROM verts) - 1) AS centrality FROM deg")
def _(spark, d):
    g, p = near(spark, d)
    return A.degree_centrality(g.nodes, p)


@v.query("a9_betweenness")
def _(spark, d):
    g, p = near(spark, d)
    return A.betweenness(g.nodes, p)


@v.query("a10_degree_histogram", deg + " SELECT degree, count(*) AS n FROM deg GROUP BY 1")
def _(spark, d):
    g, p = near(spark, d)
    return A.degree_histogram(g.nodes, p)
