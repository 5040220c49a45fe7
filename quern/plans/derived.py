"""Queries over derivations from fields, evidence, cleaned mentions, shared values, kept graphs and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import names as N
from quern.graph import TRADE_SQL, trade
from quern.iterate import scratch
from quern.operators import crawl as W
from quern.operators import extraction as X
from quern.operators import reasoning as Q
from quern.operators import resolution as M
from quern.operators import retrieval as R
from quern.plans.registry import Registry
from quern.sources import pages, sinks

r = Registry()
g = Registry("WITH " + TRADE_SQL)


def t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def makers(spark, d):
    """Parts as works whose makers stand in one of several fields, and brands and types as the makers."""
    p = t(spark, d, "part")
    pick = lambda k, c: F.when(F.col("p_partkey") % 3 == k, c).otherwise("")
    rows = p.select(F.concat(F.lit("Part_"), "p_partkey").alias("id"), F.col("p_size").alias("size"), pick(0, F.col("p_brand")).alias("f0"), pick(1, F.concat("p_type", F.lit(" & "), "p_brand")).alias("f1"), F.lit(None).cast("string").alias("f2"), F.lit("  ").alias("f3"), F.concat("p_type", F.lit(" (maker)")).alias("f4"))
    targets = p.select(F.concat(F.lit("Brand_"), "p_brand").alias("id"), F.col("p_brand").alias("title")).union(p.select(F.concat(F.lit("Type_"), "p_type"), F.col("p_type"))).distinct()
    return rows, targets


made = "SELECT 'Part_' || p_partkey AS src, p_size, unnest(CASE p_partkey % 3 WHEN 0 THEN ['Brand_' || p_brand] WHEN 1 THEN ['Type_' || p_type, 'Brand_' || p_brand] ELSE ['Type_' || p_type] END) AS dst FROM part"


@r.query("j3_produced", f"SELECT src, dst, CASE WHEN p_size > 25 THEN 'PRODUCED_ALBUM' ELSE 'PRODUCED_SONG' END AS rel_type FROM ({made})")
def _(spark, d):
    rows, targets = makers(spark, d)
    kinds = [("PRODUCED_ALBUM", rows.filter("size > 25")), ("PRODUCED_SONG", rows.filter("size <= 25"))]
    albums, songs = (W.edges_from_lists(some, ["f0", "f1", "f4"], targets, kind) for kind, some in kinds)
    return albums.unionByName(songs)


@r.query("j4_wrote", f"SELECT src, dst, 'WROTE' AS rel_type FROM ({made})")
def _(spark, d):
    rows, targets = makers(spark, d)
    return W.edges_from_lists(rows, ["f2", "f3", "f0", "f1", "f4"], targets, "WROTE")


@r.query("j5_contains", "SELECT 'Album_' || p_type AS src, 'Part_' || p_partkey AS dst, 'CONTAINS' AS rel_type FROM part UNION ALL SELECT 'Album_' || p_brand, 'Part_' || p_partkey, 'CONTAINS' FROM part WHERE p_partkey % 2 = 0")
def _(spark, d):
    p = t(spark, d, "part")
    songs = p.select(F.concat(F.lit("Part_"), "p_partkey").alias("id"), F.when(F.col("p_partkey") % 2 == 0, F.concat("p_type", F.lit(", "), "p_brand")).otherwise(F.col("p_type")).alias("Tên album"))
    albums = p.select(F.col("p_type").alias("title")).union(p.select("p_brand")).distinct().select(F.concat(F.lit("Album_"), "title").alias("id"), F.concat("title", F.lit(" (album)")).alias("title"))
    return W.edges_from_lists(songs, ["Tên album"], albums, "CONTAINS").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "rel_type")


@g.query("f10_evidenced_links", """, box AS (SELECT 'Part_' || p_partkey AS id, CASE WHEN p_size > 25 THEN p_brand || ', others' ELSE 'nobody' END AS label_field, p_type AS genre_field FROM part)
SELECT e.src, e.dst, CASE WHEN starts_with(e.dst, 'Brand_') THEN 'RELEASED_BY' ELSE 'OF_GENRE' END AS rel_type FROM edges e JOIN box ON e.src = box.id
WHERE e.rel_type = 'IS_GENRE' AND (starts_with(e.dst, 'Type_') OR contains(lower(label_field), lower(substr(e.dst, 7))))""")
def _(spark, d):
    whole = trade(spark, d)
    box = t(spark, d, "part").select(F.concat(F.lit("Part_"), "p_partkey").alias("box_id"), F.create_map(F.lit("Hãng đĩa"), F.when(F.col("p_size") > 25, F.concat("p_brand", F.lit(", others"))).otherwise("nobody"), F.lit("Thể loại"), F.col("p_type")).alias("infobox"))
    nodes = whole.nodes.join(box, F.col("id") == F.col("box_id"), "left").select("id", "label", "title", "infobox")
    return W.evidenced_links(whole.of_type("IS_GENRE"), nodes, [("Part", "Brand", "src", "Hãng đĩa", "RELEASED_BY"), ("Part", "Type", "src", "Thể loại", "OF_GENRE")])


@r.query("n9_mentions", r"""SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN c_mktsegment || ' one' WHEN 1 THEN c_mktsegment WHEN 2 THEN 'Blue ' || c_mktsegment || ' x' WHEN 3 THEN c_mktsegment ELSE 'x ' || c_mktsegment END AS mention FROM customer""")
def _(spark, d):
    k = F.col("c_custkey") % 5
    raw = F.when(k == 0, F.concat(F.lit("Kpop "), "c_mktsegment", F.lit("-one"))).when(k == 1, F.concat("c_mktsegment", F.lit(" (the sec"))).when(k == 2, F.concat(F.lit("Blue-"), "c_mktsegment", F.lit("-x"))).when(k == 3, F.concat("c_mktsegment", F.lit(" (band)"))).otherwise(F.concat(F.lit(" k-pop x-"), "c_mktsegment", F.lit(" singer")))
    return t(spark, d, "customer").select("c_custkey", N.mention(raw).alias("mention"))


#: What words count for.
WEIGHTS = {"the": 1, "and": 2, "tion": 3, "zzz": 5}


@r.query("t6_keyword_score", "SELECT doc_id, CAST(CASE WHEN contains(lower(text), 'the') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'and') THEN 2 ELSE 0 END + CASE WHEN contains(lower(text), 'tion') THEN 3 ELSE 0 END + CASE WHEN contains(lower(text), 'zzz') THEN 5 ELSE 0 END AS INTEGER) AS score FROM documents WHERE score >= 3")
def _(spark, d):
    return t(spark, d, "documents").select("doc_id", X.keyword_score(F.col("text"), WEIGHTS).alias("score")).filter("score >= 3")


@g.query("m5_edge_union", ", more AS (SELECT src, dst, rel_type FROM edges WHERE rel_type = 'MEMBER_OF' UNION ALL SELECT dst, src, 'HAS_MEMBER' FROM edges WHERE rel_type = 'MEMBER_OF') SELECT rel_type, count(*) AS n FROM (SELECT * FROM edges UNION SELECT * FROM more) GROUP BY 1")
def _(spark, d):
    e = trade(spark, d).edges
    member = e.filter("rel_type = 'MEMBER_OF'")
    more = member.unionByName(member.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("HAS_MEMBER").alias("rel_type")))
    return M.edge_union(e, more).groupBy("rel_type").agg(F.count("*").alias("n"))


def next_ones(nodes, kind):
    """Questions about each node of a kind and the one with the next number."""
    k = F.substring_index("id", "_", -1).cast("long")
    return nodes.filter(F.col("label") == kind).select(F.col("id").alias("a"), F.concat(F.lit(f"{kind}_"), k + 1).alias("b"))


@r.query("q6_same_genre", "SELECT 'Part_' || a.p_partkey AS a, 'Part_' || (a.p_partkey + 1) AS b, coalesce(a.p_type = b.p_type OR a.p_brand = b.p_brand, false) AS same, list_sort(list_filter([CASE WHEN a.p_type = b.p_type THEN 'Type_' || a.p_type END, CASE WHEN a.p_brand = b.p_brand THEN 'Brand_' || a.p_brand END], lambda x: x IS NOT NULL)) AS common FROM part a LEFT JOIN part b ON b.p_partkey = a.p_partkey + 1")
def _(spark, d):
    whole = trade(spark, d)
    return Q.shared(next_ones(whole.nodes, "Part"), whole.of_type("IS_GENRE").select(F.col("src").alias("id"), F.col("dst").alias("value")))


years = "SELECT 'Customer_' || o_custkey AS id, CAST(year(o_orderdate) AS INTEGER) AS value FROM orders"


@r.query("q6_same_year", f"WITH y AS ({years}), p AS (SELECT 'Customer_' || c_custkey AS a, 'Customer_' || (c_custkey + 1) AS b FROM customer), s AS (SELECT a, b, list_sort(list(DISTINCT m.value)) AS common FROM p JOIN y m ON m.id = a JOIN y n ON n.id = b AND m.value = n.value GROUP BY 1, 2) SELECT p.a, p.b, common IS NOT NULL AS same, coalesce(common, []) AS common FROM p LEFT JOIN s USING (a, b)")
def _(spark, d):
    """Customers with an order in the same year."""
    has = t(spark, d, "orders").select(F.concat(F.lit("Customer_"), "o_custkey").alias("id"), F.year("o_orderdate").alias("value"))
    return Q.shared(next_ones(trade(spark, d).nodes, "Customer"), has)


@r.query("q6_same_debut", f"WITH y AS (SELECT id, min(value) AS value FROM ({years}) GROUP BY 1), p AS (SELECT 'Customer_' || c_custkey AS a, 'Customer_' || (c_custkey + 1) AS b FROM customer) SELECT a, b, coalesce(m.value = n.value, false) AS same, CASE WHEN m.value = n.value THEN [m.value] ELSE [] END AS common FROM p LEFT JOIN y m ON m.id = a LEFT JOIN y n ON n.id = b")
def _(spark, d):
    """Customers whose first order is of the same year."""
    has = t(spark, d, "orders").groupBy(F.concat(F.lit("Customer_"), "o_custkey").alias("id")).agg(F.min(F.year("o_orderdate")).alias("value"))
    return Q.shared(next_ones(trade(spark, d).nodes, "Customer"), has)


@g.query("q7_same_year_via_nation", """, y AS (SELECT 'Nation_' || c_nationkey AS id, CAST(min(year(o_orderdate)) AS INTEGER) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
own AS (SELECT * FROM y UNION SELECT src, value FROM edges JOIN y ON dst = y.id WHERE rel_type = 'MEMBER_OF'), p AS (SELECT 'Supplier_' || s_suppkey AS a, 'Supplier_' || (s_suppkey + 1) AS b FROM supplier)
SELECT a, b, coalesce(m.value = n.value, false) AS same, CASE WHEN m.value = n.value THEN [m.value] ELSE [] END AS common FROM p LEFT JOIN own m ON m.id = a LEFT JOIN own n ON n.id = b""")
def _(spark, d):
    """Suppliers by the years of their nations' first orders."""
    whole = trade(spark, d)
    nation = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.concat(F.lit("Nation_"), "c_nationkey").alias("id")).agg(F.min(F.year("o_orderdate")).alias("value"))
    return Q.shared(next_ones(whole.nodes, "Supplier"), Q.values_via(whole, nation, "MEMBER_OF"))


@g.query("q8_collaborators", "SELECT DISTINCT a.src AS id, b.src AS mate FROM edges a JOIN edges b ON a.dst = b.dst AND a.src <> b.src WHERE a.rel_type = 'SUPPLIES' AND b.rel_type = 'SUPPLIES' UNION SELECT src, dst FROM edges WHERE rel_type = 'MANAGED_BY' UNION SELECT dst, src FROM edges WHERE rel_type = 'MANAGED_BY'")
def _(spark, d):
    return Q.collaborators(trade(spark, d), "SUPPLIES", ("MANAGED_BY",))


@g.query("r3_expanded", """, seeds AS (SELECT unnest([1, 1, 2, 2]) AS question_id, unnest(['Nation_3', 'Region_1', 'Part_5', 'Supplier_1']) AS id),
here AS (SELECT question_id, id, src, rel_type, dst, CASE WHEN id = src THEN dst ELSE src END AS far FROM seeds JOIN edges ON id = src OR id = dst),
sc AS (SELECT here.*, 1.0::DOUBLE + CASE WHEN EXISTS (SELECT 1 FROM seeds s WHERE s.question_id = here.question_id AND s.id = far) THEN 1 ELSE 0 END AS score FROM here),
per AS (SELECT DISTINCT question_id, src, rel_type, dst, score FROM (SELECT *, row_number() OVER (PARTITION BY question_id, id ORDER BY score DESC, rel_type, src, dst) AS n FROM sc) WHERE n <= 10)
SELECT question_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, rel_type, src, dst) AS INTEGER) AS place, src, rel_type, dst, score FROM per QUALIFY place <= 30""")
def _(spark, d):
    seeds = spark.createDataFrame([(1, "Nation_3"), (1, "Region_1"), (2, "Part_5"), (2, "Supplier_1")], "question_id int, id string")
    return R.expanded(trade(spark, d), seeds)


@g.query("s13_full_scan", "SELECT 'node' AS kind, label AS name, count(*) AS n FROM nodes GROUP BY 2 UNION ALL SELECT 'edge', rel_type, count(*) FROM edges GROUP BY 2")
def _(spark, d):
    folder = scratch(spark, "graph")
    sinks.write_graph(trade(spark, d), folder)
    whole = sinks.read_graph(spark, folder)
    of = lambda kind, rows, c: rows.groupBy(F.col(c).alias("name")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "name", "n")
    return of("node", whole.nodes, "label").unionByName(of("edge", whole.edges, "rel_type"))


@r.query("s14_kept_vectors", "SELECT p_partkey AS id, CAST(length(p_name) AS DOUBLE) AS first, CAST(CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 2 END AS INTEGER) AS made FROM part")
def _(spark, d):
    """Vectors made in two runs: the second makes those of texts that the first has not seen."""
    folder = scratch(spark, "vectors")
    rows = t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))
    embed = lambda run: lambda some: some.withColumn("vector", F.array(F.length("text").cast("double"), F.lit(float(run))))
    sinks.cached_vectors(rows.filter("id % 2 = 0"), embed(1), folder)
    return sinks.cached_vectors(rows, embed(2), folder).select("id", F.col("vector")[0].alias("first"), F.col("vector")[1].cast("int").alias("made"))


@r.query("s5_infobox_rows", "SELECT p_partkey AS page_id, 'Released' AS field, p_size || ' ' || p_type AS value FROM part UNION ALL SELECT p_partkey, 'Label', p_brand FROM part")
def _(spark, d):
    cell = lambda k, v: F.concat(F.lit(f"<tr><th>{k}</th><td>"), v, F.lit("</td></tr>"))
    html = F.concat(F.lit('<p>x</p><table class="infobox vcard">'), cell("Released", F.concat("p_size", F.lit("<sup>[1]</sup> "), "p_type")), cell("Label", F.concat(F.lit('<a href="/y">'), "p_brand", F.lit("</a> and more"))), F.lit("</table><table><tr><th>z</th><td>z</td></tr></table>"))
    found = pages.infoboxes(t(spark, d, "part").select(F.col("p_partkey").alias("page_id"), html.alias("html")))
    return found.select("page_id", F.explode("infobox").alias("field", "value"))
