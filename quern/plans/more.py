"""Further queries over scans, crawling, fields, relations and contexts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import names as N
from quern.graph import TRADE_SQL, trade
from quern.operators import crawl as W
from quern.operators import extraction as X
from quern.operators import paths as P
from quern.operators import retrieval as R
from quern.plans.registry import Registry
from quern.sources import pages

r = Registry()
g = Registry("WITH RECURSIVE " + TRADE_SQL)


def t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


@g.query("s10_node_scan", "SELECT id, title FROM nodes WHERE label IN ('Part', 'Supplier') AND contains(title, 'ring') ORDER BY id LIMIT 50")
def _(spark, d):
    return trade(spark, d).nodes.filter("label IN ('Part', 'Supplier') AND contains(title, 'ring')").orderBy("id").limit(50).select("id", "title")


@g.query("s18_node_by_name", "SELECT id, label, title FROM nodes WHERE title = 'NATION_7' OR id = 'NATION_7' ORDER BY id LIMIT 1")
def _(spark, d):
    return trade(spark, d).nodes.filter("title = 'NATION_7' OR id = 'NATION_7'").orderBy("id").limit(1)


@r.query("s7_member_fields", "SELECT p_partkey AS page_id, 'Current members' AS key, p_name AS value FROM part UNION ALL SELECT p_partkey, 'Past members', p_brand FROM part")
def _(spark, d):
    boxes = t(spark, d, "part").select(F.col("p_partkey").alias("page_id"), F.create_map(F.lit("Thành viên"), "p_name", F.lit("former members"), "p_brand", F.lit("other"), "p_type").alias("infobox"))
    return pages.member_fields(boxes).select("page_id", F.explode("infobox").alias("key", "value"))


hrefs = "links AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href FROM pages)"


@r.query("f3_f4_predicates", f"WITH {hrefs} SELECT DISTINCT href, regexp_matches(lower(href), '^(file|category|template|help|wikipedia|special):|list of|\\(film\\)|discography') AS excluded, regexp_matches(lower(href), 'k-pop|korea|band|singer|album|song') AS relevant FROM links")
def _(spark, d):
    return pages.links(t(spark, d, "pages")).select("href").distinct().select("href", W.excluded(F.col("href")).alias("excluded"), W.relevant(F.col("href")).alias("relevant"))


@g.query("f9_resolved_links", "SELECT DISTINCT src, dst FROM edges WHERE rel_type IN ('MEMBER_OF', 'MANAGED_BY') AND NOT starts_with(src, 'Customer_')")
def _(spark, d):
    whole = trade(spark, d)
    return W.resolved_links(whole.edges.select("src", "dst"), whole.nodes.filter("label IN ('Supplier', 'Nation', 'Region')"))


@r.query("n7_without_role", r"SELECT p_partkey AS id, trim(regexp_replace(p_name || CASE WHEN p_size % 2 = 0 THEN ' (Singer)' ELSE ' (tool)' END, '(?i)\s*\((singer|band|album)\)\s*$', '')) AS name FROM part")
def _(spark, d):
    p = t(spark, d, "part").withColumn("x", F.concat("p_name", F.when(F.col("p_size") % 2 == 0, " (Singer)").otherwise(" (tool)")))
    return p.select(F.col("p_partkey").alias("id"), N.without_role(F.col("x")).alias("name"))


@r.query("n15_hangul", "SELECT doc_id, regexp_matches(text, '[가-힣]') AS hangul FROM documents")
def _(spark, d):
    return t(spark, d, "documents").select("doc_id", N.has_hangul(F.col("text")).alias("hangul"))


@g.query("n14_facts", "SELECT src AS id, CASE rel_type WHEN 'MEMBER_OF' THEN s.title || ' is in ' || t.title || '.' ELSE s.title || ' is managed by ' || t.title || '.' END AS fact FROM edges JOIN nodes s ON src = s.id JOIN nodes t ON dst = t.id WHERE rel_type IN ('MEMBER_OF', 'MANAGED_BY')")
def _(spark, d):
    return R.facts(trade(spark, d), {"MEMBER_OF": "%s is in %s.", "MANAGED_BY": "%s is managed by %s."})


@g.query("p11_batch", """, e AS (SELECT src AS a, dst AS b FROM edges WHERE rel_type IN ('MEMBER_OF', 'MANAGED_BY') AND NOT starts_with(src, 'Customer_')), two AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
walk AS (SELECT 'Supplier_1' AS src, 'Supplier_1' AS pos, 0 AS hops UNION SELECT src, b, hops + 1 FROM walk JOIN two ON pos = a WHERE hops < 8)
SELECT src, pos AS dst, min(hops) AS hops FROM walk WHERE starts_with(pos, 'Supplier_') AND pos <> 'Supplier_1' GROUP BY 1, 2""")
def _(spark, d):
    small = trade(spark, d).typed(["Supplier", "Nation", "Region"], ["MEMBER_OF", "MANAGED_BY"])
    pairs = small.nodes.filter("label = 'Supplier' AND id <> 'Supplier_1'").select(F.lit("Supplier_1").alias("src"), F.col("id").alias("dst"))
    return P.shortest_paths(P.both_ways(small.edges.select("src", "dst")), pairs, 8).select("src", "dst", "hops")


@r.query("t4_gazetteer", "SELECT doc_id, 'Company' AS type, unnest(list_filter(['Thing', 'Que La', 'Und'], lambda n: contains(lower(text), lower(n)))) AS text, 0.95::DOUBLE AS confidence FROM documents")
def _(spark, d):
    return X.by_gazetteer(t(spark, d, "documents"), ["Thing", "Que La", "Und"], "Company")


@r.query("t9_retyped", "SELECT p_partkey AS id, p_name AS text, CASE WHEN string_split(p_name, ' ')[1] IN ('red', 'small') THEN 'Artist' ELSE 'Group' END AS type FROM part")
def _(spark, d):
    return X.retyped(t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"), F.lit("Group").alias("type")), ["red", "small"])


@r.query("t3_x7_from_fields", "SELECT p_partkey AS src, p_name AS dst, 'MEMBER_OF' AS rel_type, 0.95::DOUBLE AS confidence FROM part UNION ALL SELECT p_partkey, p_brand, 'MANAGED_BY', 0.9 FROM part UNION ALL SELECT p_partkey, p_type, 'MANAGED_BY', 0.9 FROM part")
def _(spark, d):
    rows = t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("members"), F.concat("p_brand", F.lit(", "), "p_type").alias("label"))
    return X.from_fields(rows, {"members": ("MEMBER_OF", 0.95), "label": ("MANAGED_BY", 0.9)})


@r.query("x3_classified", "SELECT doc_id, 'a' AS src, 'b' AS dst, CASE WHEN contains(lower(text), 'thing') THEN 'MEMBER_OF' ELSE 'SINGS' END AS rel_type FROM documents WHERE contains(lower(text), 'thing') OR contains(lower(text), 'que') UNION ALL SELECT doc_id, 'b', 'a', 'HAS' FROM documents WHERE contains(lower(text), 'und')")
def _(spark, d):
    p = t(spark, d, "documents").select("doc_id", F.lit("a").alias("a"), F.lit("Artist").alias("a_type"), F.lit("b").alias("b"), F.lit("Group").alias("b_type"), F.col("text").alias("between"))
    return X.classified(p, [("Artist", "Group", "MEMBER_OF", "thing"), ("Artist", "Group", "SINGS", "que"), ("Group", "Artist", "HAS", "und")])


@r.query("x6_plausible", "SELECT doc_id, source AS src, lang AS dst, 'MEMBER_OF' AS rel_type, 0.8::DOUBLE AS confidence, n_chars AS distance FROM documents WHERE n_chars <= 100 AND lang <> 'de'")
def _(spark, d):
    rows = t(spark, d, "documents").select("doc_id", F.col("source").alias("src"), F.col("lang").alias("dst"), F.lit("MEMBER_OF").alias("rel_type"), F.lit(0.8).alias("confidence"), F.col("n_chars").alias("distance"))
    return X.plausible(rows, ["de"])


@g.query("r4_seed_paths", """, pairs AS (SELECT a.src AS x, b.src AS y, a.dst AS via FROM edges a JOIN edges b ON a.dst = b.dst AND a.src < b.src WHERE a.src IN ('Supplier_1', 'Supplier_2', 'Supplier_3') AND b.src IN ('Supplier_1', 'Supplier_2', 'Supplier_3'))
SELECT 1 AS question_id, x AS src, y AS dst, [x, via, y] AS path FROM (SELECT DISTINCT * FROM pairs) QUALIFY row_number() OVER (PARTITION BY x, y ORDER BY via) <= 3""")
def _(spark, d):
    whole = trade(spark, d)
    return R.seed_paths(whole, spark.createDataFrame([(1, f"Supplier_{k}") for k in (1, 2, 3)], "question_id int, id string"))
