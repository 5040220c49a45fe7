"""Queries over names, pages, mentions, relations, resolution, retrieval and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import names as N
from quern.graph import TRADE_SQL, Graph, trade
from quern.iterate import settled
from quern.operators import crawl as W
from quern.operators import evaluation as E
from quern.operators import extraction as X
from quern.operators import resolution as M
from quern.operators import retrieval as R
from quern.operators.paths import scored, two_hops
from quern.plans.registry import Registry
from quern.sources import graphfile, pages, sinks

r = Registry()
g = Registry("WITH " + TRADE_SQL)


def t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


# names

fields = "(SELECT p_partkey AS id, p_name || ' (' || p_type || ')' AS title, p_brand || ', ' || p_type || ' & ' || p_name AS list, 'from ' || (1990 + p_size) || '–' || (2000 + p_size) || ' on' AS era FROM part)"


def parts(spark, d):
    p = t(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" ("), "p_type", F.lit(")")).alias("title"), F.concat("p_brand", F.lit(", "), "p_type", F.lit(" & "), "p_name").alias("list"), F.concat(F.lit("from "), F.col("p_size") + 1990, F.lit("–"), F.col("p_size") + 2000, F.lit(" on")).alias("era"))


@r.query("n1_derived_nodes", f"SELECT DISTINCT 'Genre_' || x AS id, 'Genre' AS label, x AS title FROM (SELECT trim(unnest(regexp_split_to_array(list, ', | & '))) AS x FROM {fields}) WHERE len(x) > 2")
def _(spark, d):
    return W.derived_nodes(parts(spark, d), "list", "Genre")


@r.query("n2_n4_normalisers", "SELECT * FROM (VALUES ('hip hop', 'Hip-hop', 'Hip Hop', 'hip hop'), ('edm', 'EDM', 'Edm', 'edm'), ('k-pop', '', 'K-pop', 'k-pop'), ('vocal', 'Vocal', 'Vocals', 'vocal'), ('singer', 'Singer', 'Singer', 'Ca sĩ'), ('soft rock', 'Soft Rock', 'Soft Rock', 'soft rock')) t(raw, genre, instrument, occupation)")
def _(spark, d):
    rows = spark.createDataFrame([(x,) for x in ("hip hop", "edm", "k-pop", "vocal", "singer", "soft rock")], "raw string")
    return rows.select("raw", N.genre(F.col("raw")).alias("genre"), N.instrument(F.col("raw")).alias("instrument"), N.occupation(F.col("raw")).alias("occupation"))


@r.query("n5_first_rule", "SELECT p_partkey AS id, CASE WHEN contains(lower(p_name), 'red') THEN 'Red House' WHEN contains(lower(p_name), 'small') THEN NULL WHEN contains(lower(p_name), 'ring') THEN 'Ring Co' ELSE p_name END AS company FROM part")
def _(spark, d):
    return t(spark, d, "part").select(F.col("p_partkey").alias("id"), N.first_rule(F.col("p_name"), [("red", "Red House"), ("small", None), ("ring", "Ring Co")]).alias("company"))


@r.query("n6_n10_keys", rf"""SELECT id, lower(trim(regexp_replace(title, '\s*\([^)]*\)', ''))) AS title_key, regexp_replace(title, '\s*\([^)]+\)\s*$', '') AS display,
translate(lower(title), ' -_', '') AS compare_key, 'x | loại: Part | ' || title AS node_text FROM {fields}""")
def _(spark, d):
    p, title = parts(spark, d), F.col("title")
    return p.select("id", N.title_key(title).alias("title_key"), N.display(title).alias("display"), N.compare_key(title).alias("compare_key"), N.node_text(F.lit("x"), F.lit("Part"), title).alias("node_text"))


@r.query("n11_n12_years", rf"SELECT id, CAST(regexp_extract(era, '(\d{{4}})', 1) AS INTEGER) AS first_year, regexp_extract(era, '(\d{{4}})', 1) || '–' || regexp_extract(era, '–(\d{{4}})', 1) AS years FROM {fields}")
def _(spark, d):
    return parts(spark, d).select("id", N.first_year(F.col("era")).alias("first_year"), N.year_range(F.col("era")).alias("years"))


@r.query("n16_same_company", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_name < b.n_name WHERE contains(b.n_name, a.n_name) OR contains(a.n_name, b.n_name)")
def _(spark, d):
    n = t(spark, d, "nation").select(F.col("n_name").alias("a"))
    return n.join(F.broadcast(n.withColumnRenamed("a", "b")), F.col("a") < F.col("b")).filter(N.same_company(F.col("a"), F.col("b")))


@r.query("s12_folded_keys", "SELECT n_name AS name, trim(regexp_replace(lower(n_name), '[^a-z0-9]+', '_', 'g'), '_') AS key FROM nation")
def _(spark, d):
    return t(spark, d, "nation").select(F.col("n_name").alias("name"), N.folded(F.col("n_name")).alias("key"))


# sources and sinks


@g.query("s1_s3_json_round_trip", "SELECT rel_type, count(*) AS n FROM edges WHERE rel_type IN ('MEMBER_OF', 'MANAGED_BY') GROUP BY 1")
def _(spark, d):
    from quern.iterate import scratch

    small = trade(spark, d).typed(["Customer", "Supplier", "Nation", "Region"], ["MEMBER_OF", "MANAGED_BY"])
    folder = scratch(spark, "graph")
    graphfile.save(Graph(small.nodes, small.edges.select("src", "dst", "rel_type")), folder)
    return graphfile.read_back(spark, folder).edges.groupBy("rel_type").agg(F.count("*").alias("n"))


@g.query("s2_united_load", "SELECT label, count(*) AS n FROM nodes WHERE label IN ('Region', 'Nation', 'Supplier') GROUP BY 1")
def _(spark, d):
    whole = trade(spark, d)
    base = whole.typed(["Region", "Nation"])
    more = whole.nodes.filter("label IN ('Nation', 'Supplier')")
    return graphfile.united(base, more, whole.of_type("MEMBER_OF")).nodes.groupBy("label").agg(F.count("*").alias("n"))


@g.query("s11_upsert", "SELECT id, CASE WHEN label = 'Nation' THEN 'Country' ELSE label END AS label, title FROM nodes WHERE label IN ('Nation', 'Region') UNION ALL SELECT 'New_1', 'Country', NULL")
def _(spark, d):
    have = trade(spark, d).nodes.filter("label IN ('Nation', 'Region')")
    new = have.filter("label = 'Nation'").select("id", F.lit("Country").alias("label"), F.lit(None).cast("string").alias("title"), F.lit(1).cast("long").alias("ord"))
    return sinks.upsert(have, new.union(spark.sql("SELECT 'New_1', 'Country', CAST(NULL AS STRING), CAST(1 AS BIGINT)")), ["id"])


@g.query("s15_reconciliation", """SELECT rel_type, state, count(*) AS n FROM (SELECT rel_type, CASE WHEN starts_with(src, 'Supplier_') THEN 'source missing' WHEN rel_type = 'MANAGED_BY' THEN 'relation missing' ELSE 'present' END AS state
FROM edges WHERE rel_type IN ('MEMBER_OF', 'MANAGED_BY')) GROUP BY 1, 2""")
def _(spark, d):
    whole = trade(spark, d)
    e = whole.of_type("MEMBER_OF", "MANAGED_BY")
    return sinks.reconciliation(sinks.reconciled(e, whole.nodes.filter("label <> 'Supplier'"), e.filter("rel_type = 'MEMBER_OF'")))


@g.query("s16_repair", "SELECT src, dst, rel_type FROM edges WHERE rel_type = 'MANAGED_BY'")
def _(spark, d):
    whole = trade(spark, d)
    e = whole.of_type("MANAGED_BY")
    wrong = e.withColumn("src", F.concat(F.lit("Kpop "), "src"))
    return sinks.repaired(whole.nodes, e.unionByName(wrong))[1]


@g.query("s17_triples", "SELECT src AS s, min(rel_type) AS p, dst AS o FROM edges GROUP BY 1, 3")
def _(spark, d):
    return graphfile.triples(trade(spark, d))


@r.query("s8_page_text", r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html,
 '<(script|style|nav)[^>]*>.*?</(script|style|nav)>|<!--.*?-->', ' ', 'gs'), '<[^>]*>', ' ', 'g'), '\[[0-9]+\]', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '[ \t\n\r]+', ' ', 'g')) AS text FROM pages""")
def _(spark, d):
    return t(spark, d, "pages").select("page_id", pages.text(F.col("html")).alias("text"))


@r.query("s9_corpus", r"""SELECT page_id, url, text, CAST(len(text) AS INTEGER) AS text_length FROM (SELECT page_id, url, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html,
 '<(script|style|nav)[^>]*>.*?</(script|style|nav)>|<!--.*?-->', ' ', 'gs'), '<[^>]*>', ' ', 'g'), '\[[0-9]+\]', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '[ \t\n\r]+', ' ', 'g')) AS text FROM pages) WHERE len(text) >= 500""")
def _(spark, d):
    return pages.corpus(t(spark, d, "pages"))


@r.query("s5_infoboxes", "SELECT page_id, 0::BIGINT AS fields FROM pages")
def _(spark, d):
    return pages.infoboxes(t(spark, d, "pages")).select("page_id", F.size("infobox").cast("long").alias("fields"))


# crawl

hrefs = """links AS (SELECT page_id, CAST(generate_subscripts(h, 1) - 1 AS INTEGER) AS place, unnest(h) AS href FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS h FROM pages))"""
score = "-0.5 * 1 + CASE WHEN len(href) > 60 THEN -4 ELSE 0 END + CASE WHEN regexp_matches(lower(href), 'music|song|album|the') THEN 8 ELSE 0 END + CASE WHEN regexp_matches(lower(href), '\\(band\\)|\\(group\\)') THEN 10 ELSE 0 END + CASE WHEN regexp_matches(lower(href), 'entertainment|records') THEN -50 ELSE 0 END + CASE WHEN regexp_matches(lower(href), 'film|list of') THEN -20 ELSE 0 END"


@r.query("f1_links", "WITH " + hrefs + " SELECT page_id, place, href FROM links")
def _(spark, d):
    return pages.links(t(spark, d, "pages"))


@r.query("f1_crawl")
def _(spark, d):
    p = pages.links(t(spark, d, "pages")).select(F.concat(F.lit("/page/"), "page_id").alias("src"), F.col("href").alias("dst"))
    return W.crawl(p, spark.createDataFrame([("/page/0",), ("/page/1",)], "id string"))


@r.query("f2_link_scores", "WITH " + hrefs + f" SELECT DISTINCT href, CAST({score} AS DOUBLE) AS score FROM links")
def _(spark, d):
    return pages.links(t(spark, d, "pages")).select("href").distinct().withColumn("score", W.link_score(F.col("href"), F.lit(1)))


evidence = [("text", "the", "Group", 3.0), ("text", "und", "Artist", 2.0), ("text", "la", "Album", 2.0), ("text", "que", "Album", 1.0), ("lang", "^en$", "Group", 1.0)]


@r.query("f5_label_of", """SELECT id, CASE WHEN a >= greatest(g, b) THEN 'Artist' WHEN g >= b THEN 'Group' ELSE 'Album' END AS label, greatest(a, g, b) AS score
FROM (SELECT doc_id AS id, CASE WHEN contains(lower(text), 'und') THEN 2::DOUBLE ELSE 0 END AS a, CASE WHEN contains(lower(text), 'the') THEN 3::DOUBLE ELSE 0 END + CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS g,
CASE WHEN contains(lower(text), 'la') THEN 2::DOUBLE ELSE 0 END + CASE WHEN contains(lower(text), 'que') THEN 1 ELSE 0 END AS b FROM documents) WHERE greatest(a, g, b) > 0""")
def _(spark, d):
    docs = t(spark, d, "documents")
    rows = docs.select(F.col("doc_id").alias("id"), F.lit("text").alias("field"), F.col("text").alias("value")).unionByName(docs.select(F.col("doc_id").alias("id"), F.lit("lang").alias("field"), F.col("lang").alias("value")))
    return W.label_of(rows, evidence, ["Artist", "Group", "Album"])


@r.query("f6_relevance", """SELECT doc_id AS id, CASE WHEN lang = 'de' THEN 0::DOUBLE ELSE CASE WHEN contains(lower(text), 'thing') THEN 5::DOUBLE ELSE 0 END + CASE WHEN contains(lower(text), 'ou') THEN 2 ELSE 0 END - CASE WHEN contains(lower(text), 'zz') THEN 3 ELSE 0 END END AS score FROM documents""")
def _(spark, d):
    docs = t(spark, d, "documents")
    rows = docs.select(F.col("doc_id").alias("id"), F.lit("text").alias("field"), F.col("text").alias("value")).unionByName(docs.select(F.col("doc_id").alias("id"), F.lit("lang").alias("field"), F.col("lang").alias("value")))
    return W.relevance(rows, [("text", "thing", 5.0, False), ("text", "ou", 2.0, False), ("text", "zz", -3.0, False), ("lang", "^de$", 0.0, True)])


@r.query("f8_duplicate_pages", "SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY text) AS kept FROM documents")
def _(spark, d):
    return W.duplicates(t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), F.col("text"))


@g.query("f10_f11_typed_links", "SELECT src, dst, CASE WHEN starts_with(src, 'Supplier_') THEN 'SELLS' ELSE 'HOLDS' END AS rel_type FROM edges WHERE rel_type IN ('SUPPLIES', 'CONTAINS')")
def _(spark, d):
    whole = trade(spark, d)
    return W.typed_links(whole.edges.select("src", "dst"), whole.nodes, [("Supplier", "Part", "SELLS"), ("Order", "Part", "HOLDS")])


# derivation joins


@r.query("j1_word_members", "SELECT DISTINCT 'w_' || w AS src, p_partkey AS dst FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS w, p_partkey FROM part) WHERE w IN ('red', 'ring', 'widget')")
def _(spark, d):
    words = spark.createDataFrame([("w_red", "Red"), ("w_ring", "Ring (thing)"), ("w_widget", "WIDGET")], "id string, title string")
    return W.word_members(words, t(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_name"), "p_name")


@r.query("j2_j6_edges_from_lists", "SELECT p_partkey AS src, 'T_' || p_type AS dst, 'IS_GENRE' AS rel_type FROM part UNION ALL SELECT p_partkey, 'B_' || p_brand, 'IS_GENRE' FROM part")
def _(spark, d):
    p = t(spark, d, "part")
    rows = p.select(F.col("p_partkey").alias("id"), F.lit("").alias("none"), F.concat("p_type", F.lit(", "), "p_brand").alias("list"))
    targets = p.select(F.concat(F.lit("T_"), "p_type").alias("id"), F.col("p_type").alias("title")).union(p.select(F.concat(F.lit("B_"), "p_brand"), F.concat("p_brand", F.lit(" (brand)")))).distinct()
    return W.edges_from_lists(rows, ["none", "list"], targets, "IS_GENRE")


@r.query("j7_sub_units", """WITH n AS (SELECT DISTINCT p_name AS id FROM part UNION SELECT DISTINCT string_split(p_name, ' ')[1] FROM part)
SELECT a.id AS src, b.id AS dst FROM n a JOIN n b ON starts_with(lower(a.id), lower(b.id) || ' ') AND a.id <> b.id""")
def _(spark, d):
    p = t(spark, d, "part")
    names = p.select(F.col("p_name").alias("id")).union(p.select(F.split("p_name", " ")[0])).distinct()
    return W.sub_units(names.select("id", F.col("id").alias("title")))


# mentions

bank = [("Artist", r"([A-Z][a-z]+), [a-z]+ the"), ("Group", r"([A-Z][a-z]+) of the"), ("Song", r"the ([a-z]{9,12})\.")]
bank_sql = " UNION ".join(f"SELECT doc_id, '{k}' AS type, unnest(regexp_extract_all(text, '{p}', 1)) AS text, 0.7::DOUBLE AS confidence FROM documents" for k, p in bank)


@r.query("t1_pattern_bank", bank_sql)
def _(spark, d):
    return X.by_patterns(t(spark, d, "documents"), bank)


@r.query("t2_lists", r"""SELECT * FROM (SELECT DISTINCT doc_id, 'Artist' AS type, trim(unnest(regexp_split_to_array(list, ', | and '))) AS text, 0.8::DOUBLE AS confidence
FROM (SELECT doc_id, unnest(regexp_extract_all(text, 'that ([a-z]+, [a-z]+ and [a-z]+)', 1)) AS list FROM documents)) WHERE len(text) > 2""")
def _(spark, d):
    return X.from_lists(t(spark, d, "documents"), "that ([a-z]+, [a-z]+ and [a-z]+)", "Artist")


@r.query("t5_valid", f"SELECT * FROM ({bank_sql}) WHERE len(text) BETWEEN 2 AND 50 AND NOT regexp_matches(text, '^The') AND NOT regexp_matches(text, 'ing$') AND lower(text) NOT IN ('and', 'for')")
def _(spark, d):
    return X.valid(X.by_patterns(t(spark, d, "documents"), bank), [("article", "^The"), ("gerund", "ing$")], ["and", "for"])


def entities(spark, d):
    return X.merged(X.by_patterns(t(spark, d, "documents"), bank).withColumn("rank", F.when(F.col("type") == "Group", 0).otherwise(1)))


merged_sql = f"SELECT translate(lower(text), ' -_', '') AS key, type, min(text) AS text, list_sort(list(DISTINCT doc_id)) AS sources, max(confidence) AS confidence FROM ({bank_sql}) GROUP BY 1, 2"


@r.query("t7_merged", merged_sql)
def _(spark, d):
    return entities(spark, d)


@r.query("t8_boosted", f"""SELECT key, type, text, sources, round(CASE WHEN key IN ('and', 'the') THEN least(c + 0.1, 1) ELSE c END, 6)::DOUBLE AS confidence FROM (SELECT *, CASE WHEN len(sources) >= 5 THEN 0.9 WHEN len(sources) >= 3 THEN 0.85 WHEN len(sources) >= 2 THEN 0.8 ELSE 0.7 END AS c FROM ({merged_sql}))""")
def _(spark, d):
    return X.boosted(entities(spark, d), ["and", "the"])


@r.query("t12_counts", f"SELECT type, count(*) AS n FROM ({merged_sql}) GROUP BY 1")
def _(spark, d):
    return entities(spark, d).groupBy("type").agg(F.count("*").alias("n"))


@r.query("t6_context", f"""SELECT doc_id, type, m.text, substr(d.text, greatest(p - 100, 1), p - greatest(p - 100, 1) + len(m.text) + 100) AS context FROM (SELECT doc_id, type, text FROM ({bank_sql})) m JOIN documents d USING (doc_id), LATERAL (SELECT instr(d.text, m.text) AS p) WHERE p > 0""")
def _(spark, d):
    docs = t(spark, d, "documents")
    return X.context(X.by_patterns(docs, bank), docs).select("doc_id", "type", "text", "context")


@r.query("t11_judged", f"SELECT doc_id, type, text, CASE WHEN len(text) > 5 THEN 0.8::DOUBLE ELSE 0.7 END AS confidence FROM ({bank_sql}) WHERE NOT starts_with(text, 'A')")
def _(spark, d):
    def judge(frame):
        return frame["text"].map(lambda x: "INVALID" if x.startswith("A") else "VALID" if len(x) > 5 else "UNCERTAIN")

    return X.judged(X.by_patterns(t(spark, d, "documents"), bank), judge).withColumn("confidence", F.round("confidence", 6))


words_sql = """tok AS (SELECT doc_id, w AS name, CAST(start AS INTEGER) AS start, CAST(start + len(w) AS INTEGER) AS "end" FROM (SELECT doc_id, unnest(words) AS w, unnest(starts) AS start FROM (SELECT doc_id, words, list_transform(generate_series(1, len(words)), lambda i: 1 + coalesce(list_sum(list_transform(words[1:i - 1], lambda w: len(w) + 1)), 0)) AS starts
 FROM (SELECT doc_id, string_split(text, ' ') AS words FROM documents))) WHERE w IN ('the', 'thing', 'ou', 'that', 'for'))"""


def spans(spark, d):
    return X.tokens(t(spark, d, "documents")).filter(F.col("word").isin("the", "thing", "ou", "that", "for")).select("doc_id", F.col("word").alias("name"), "start", (F.col("start") + F.length("word")).alias("end"))


@r.query("x1_mention_spans")
def _(spark, d):
    dictionary = spark.createDataFrame([("of the", "A"), ("the", "B"), ("and the", "A"), ("that", "B")], "name string, type string")
    return X.by_dictionary(t(spark, d, "documents"), dictionary)


@r.query("x2_near_pairs", "WITH " + words_sql + """ SELECT a.doc_id, least(a.name, b.name) AS first, greatest(a.name, b.name) AS second, min(b.start - a."end") AS gap FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.start - a."end" BETWEEN 0 AND 150 AND a.name <> b.name GROUP BY 1, 2, 3""")
def _(spark, d):
    return X.near_pairs(spans(spark, d))


@r.query("x5_confidence", "SELECT doc_id, round(greatest(0, least(0.95, 0.7 + CASE WHEN contains(text, 'thing') THEN 0.15 ELSE -0.1 END + least(0.05 * (doc_id % 4), 0.1) - CASE WHEN len(text) > 300 THEN 0.2 WHEN len(text) > 200 THEN 0.15 ELSE 0 END)), 6)::DOUBLE AS confidence FROM documents")
def _(spark, d):
    return t(spark, d, "documents").select("doc_id", F.round(X.confidence(F.contains("text", F.lit("thing")), F.col("doc_id") % 4, F.length("text")), 6).alias("confidence"))


together_sql = "WITH " + words_sql + ", o AS (SELECT DISTINCT doc_id, name FROM tok), c AS (SELECT a.name AS a, b.name AS b, count(*) AS n FROM o a JOIN o b ON a.doc_id = b.doc_id AND a.name < b.name GROUP BY 1, 2)"


@r.query("x8_cooccurrence", together_sql + " SELECT * FROM c")
def _(spark, d):
    return X.cooccurrence(spans(spark, d))


@r.query("x9_boost", together_sql + " SELECT a AS src, b AS dst, round(least(0.5 + least(0.03 * n, 0.15), 0.98), 6)::DOUBLE AS confidence FROM c")
def _(spark, d):
    c = settled(X.cooccurrence(spans(spark, d)))
    return X.boost(c.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(0.5).alias("confidence")), c)


@g.query("x10_unseen", "SELECT src, dst, rel_type FROM edges WHERE rel_type = 'MANAGED_BY'")
def _(spark, d):
    whole = trade(spark, d)
    again = whole.of_type("MEMBER_OF", "MANAGED_BY").select(F.upper("src").alias("src"), "dst", "rel_type")
    return X.unseen(again.unionByName(again), whole.of_type("MEMBER_OF")).withColumn("src", F.initcap("src"))


@g.query("x11_degree_report", "SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def _(spark, d):
    return X.degree_report(trade(spark, d).edges)


@r.query("x12_chunks", "SELECT doc_id, CAST(i AS INTEGER) AS chunk, substr(text, CAST(i * 1800 + 1 AS BIGINT), 2000) AS part FROM documents, LATERAL (SELECT unnest(generate_series(0, greatest(len(text) - 201, 0) // 1800)) AS i)")
def _(spark, d):
    return X.chunks(t(spark, d, "documents"))


# resolution


def mentions_of_parts(spark, d):
    p = t(spark, d, "part")
    return p.select(F.upper(F.translate("p_type", " ", "-")).alias("text"), F.lit("Type").alias("type"), F.lit(0.9).alias("confidence"), F.lit("rule").alias("method")).distinct().union(p.select("p_brand", F.lit("Type"), F.lit(0.8), F.lit("list")).distinct())


@g.query("m1_enriched", "SELECT id, label, title, CASE WHEN label = 'Type' THEN 0.9::DOUBLE END AS ner_confidence, CASE WHEN label = 'Type' THEN 'rule' END AS ner_method FROM nodes WHERE label IN ('Type', 'Brand')")
def _(spark, d):
    return M.enriched(trade(spark, d).nodes.filter("label IN ('Type', 'Brand')"), mentions_of_parts(spark, d))


@g.query("m2_claimed", "SELECT title AS id, 'Type' AS label, CAST(NULL AS VARCHAR) AS original_name FROM nodes WHERE label = 'Brand'")
def _(spark, d):
    return M.claimed(trade(spark, d).nodes.filter("label IN ('Type', 'Brand')"), mentions_of_parts(spark, d))


@r.query("m3_resolved_ends", """WITH m AS (SELECT DISTINCT string_split(p_name, ' ')[1] AS name FROM part UNION SELECT DISTINCT p_name FROM part), n AS (SELECT DISTINCT p_name AS id FROM part),
k AS (SELECT name, translate(lower(name), ' -_', '') AS mk FROM m), l AS (SELECT id, translate(lower(id), ' -_', '') AS nk FROM n),
c AS (SELECT name, id, len(mk) + 100 AS score FROM k JOIN l ON mk = nk UNION ALL SELECT name, id, least(len(mk), len(nk)) + 50 FROM k JOIN l ON mk <> nk AND (contains(mk, nk) OR contains(nk, mk)) AND list_has_any(list_filter(string_split(lower(name), ' '), lambda w: len(w) >= 3), string_split(lower(id), ' ')))
SELECT name, 'Part' AS type, arg_min(id, (-score, id)) AS id, CAST(max(score) AS INTEGER) AS score FROM c GROUP BY 1""")
def _(spark, d):
    p = t(spark, d, "part")
    names = p.select(F.split("p_name", " ")[0].alias("name")).union(p.select("p_name")).distinct().withColumn("type", F.lit("Part"))
    nodes = p.select(F.col("p_name").alias("id"), F.lit("Part").alias("label"), F.col("p_name").alias("title")).distinct()
    return M.resolved_ends(names, nodes)


@g.query("m4_m5_placed", "SELECT missing, count(*) AS n FROM (SELECT CASE WHEN starts_with(src, 'Supplier_') THEN 'source' ELSE 'none' END AS missing FROM edges WHERE rel_type = 'MEMBER_OF') GROUP BY 1")
def _(spark, d):
    whole = trade(spark, d)
    of = whole.nodes.filter("label <> 'Supplier'").select(F.col("id").alias("name"), F.col("label").alias("type"), "id")
    rel = whole.of_type("MEMBER_OF").select("src", F.split("src", "_")[0].alias("src_type"), "dst", F.split("dst", "_")[0].alias("dst_type"), "rel_type")
    return M.placed(rel, of).groupBy("missing").agg(F.count("*").alias("n"))


# retrieval


@r.query("r2_semantic", """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), p AS (SELECT q.vec_id AS query_id, c.vec_id AS id, list_dot_product(q.e, c.e) / sqrt(list_dot_product(q.e, q.e) * list_dot_product(c.e, c.e)) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS place, id, round(score, 6) AS score FROM p QUALIFY place <= 5""")
def _(spark, d):
    v = t(spark, d, "embeddings")
    return R.semantic(v.filter("vec_id % 20 = 0"), v).withColumn("score", F.round("score", 6))


@g.query("r5_reranked")
def _(spark, d):
    whole = trade(spark, d)
    seeds = spark.createDataFrame([(1, "Nation_3"), (2, "Part_5")], "question_id int, id string")
    degree = whole.both_ways().groupBy("id").agg(F.count("*").alias("degree"))
    return R.reranked(R.expanded(whole, seeds), degree, spark.createDataFrame([(1, "nation"), (1, "member"), (2, "part")], "question_id int, word string"))


@g.query("r6_context_text")
def _(spark, d):
    seeds = spark.createDataFrame([(1, "Nation_3"), (2, "Part_5")], "question_id int, id string")
    return R.context_text(R.expanded(trade(spark, d), seeds), 50)


@g.query("r7_multi_hop")
def _(spark, d):
    return R.multi_hop(trade(spark, d), spark.createDataFrame([(1, "Nation_3"), (2, "Part_5")], "question_id int, id string"))


@g.query("r1_r8_linked")
def _(spark, d):
    names = R.variants(trade(spark, d).nodes.filter("label IN ('Part', 'Brand', 'Type')"))
    questions = t(spark, d, "part").select(F.col("p_partkey").alias("question_id"), F.concat(F.lit("Which supplier sells the "), "p_name", F.lit(" of "), "p_brand", F.lit("?")).alias("question"))
    return R.linked(questions, names)


@r.query("q12_intents", "SELECT doc_id AS question_id, CASE WHEN contains(lower(text), 'thing') THEN 'things' WHEN contains(lower(text), 'que') THEN 'what' ELSE 'generic' END AS intent FROM documents")
def _(spark, d):
    q = t(spark, d, "documents").select(F.col("doc_id").alias("question_id"), F.col("text").alias("question"))
    return R.intents(q, [("thing", "things"), ("que", "what")])


@r.query("q16_best_choice", "SELECT p_partkey AS question_id, p_type AS answer FROM part")
def _(spark, d):
    p = t(spark, d, "part")
    return R.best_choice(p.select(F.col("p_partkey").alias("question_id"), F.concat("p_name", F.lit(" is "), "p_type").alias("facts"), F.array(F.lit("NOTHING"), "p_type", F.lit("OTHER")).alias("choices")))


@r.query("q17_history", """SELECT conv_id, turn, coalesce(list(role || ': ' || text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), []) AS recent FROM conversations""")
def _(spark, d):
    return R.history(t(spark, d, "conversations"))


# evaluation


@g.query("e1_true_false")
def _(spark, d):
    return E.true_false(trade(spark, d).of_type("MEMBER_OF", "MANAGED_BY"), 60)


@g.query("e2_two_hop_questions", """, p AS (SELECT DISTINCT a.src AS start, a.rel_type AS rel1, b.rel_type AS rel2, b.dst AS "end", CASE WHEN a.rel_type = 'MEMBER_OF' AND b.rel_type = 'MANAGED_BY' THEN 10 WHEN a.rel_type = 'SUPPLIES' AND b.rel_type = 'IS_GENRE' THEN 7 ELSE 1 END AS score
FROM edges a JOIN edges b ON a.dst = b.src WHERE a.rel_type IN ('MEMBER_OF', 'SUPPLIES') AND b.rel_type IN ('MANAGED_BY', 'IS_GENRE')),
n AS (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, md5(start || '|' || "end"), start, "end", rel1, rel2) AS INTEGER) AS n FROM p)
SELECT CASE WHEN n <= 40 THEN 'true_false' WHEN n <= 70 THEN 'yes_no' ELSE 'choice' END AS kind, n, start, rel1, rel2, "end" FROM n WHERE n <= 100""")
def _(spark, d):
    e = trade(spark, d).of_type("MEMBER_OF", "SUPPLIES", "MANAGED_BY", "IS_GENRE")
    return E.two_hop_questions(scored(two_hops(e).filter("shape = 'forward'")), {"true_false": 40, "yes_no": 30, "choice": 30})


@g.query("e3_distractors", """, q AS (SELECT DISTINCT src AS start FROM edges WHERE rel_type = 'MEMBER_OF' AND starts_with(src, 'Supplier_')), pool AS (SELECT id AS wrong FROM nodes WHERE label = 'Nation'),
c AS (SELECT start, wrong, row_number() OVER (PARTITION BY start ORDER BY md5(start || '|' || wrong)) AS place FROM q, pool WHERE NOT EXISTS (SELECT 1 FROM edges WHERE src = start AND dst = wrong AND rel_type = 'MEMBER_OF'))
SELECT start, wrong, CAST(place AS INTEGER) AS place FROM c WHERE place <= 3""")
def _(spark, d):
    whole = trade(spark, d)
    truth = whole.of_type("MEMBER_OF").filter("src LIKE 'Supplier%'").select(F.col("src").alias("start"), F.col("dst").alias("end"))
    return E.distractors(truth, truth, whole.nodes.filter("label = 'Nation'").select("id"))


@r.query("e4_accuracy", "SELECT hops, type, count(*) AS n, round(avg(CASE WHEN answer = predicted THEN 1 ELSE 0 END), 9) AS accuracy, round(avg(seconds), 9) AS mean_seconds FROM (SELECT l_linenumber AS hops, l_returnflag AS type, l_linestatus AS answer, CASE WHEN l_quantity > 25 THEN 'F' ELSE 'O' END AS predicted, l_tax AS seconds FROM lineitem) GROUP BY GROUPING SETS ((hops), (type), ())")
def _(spark, d):
    rows = t(spark, d, "lineitem").select(F.col("l_linenumber").alias("hops"), F.col("l_returnflag").alias("type"), F.col("l_linestatus").alias("answer"), F.when(F.col("l_quantity") > 25, "F").otherwise("O").alias("predicted"), F.col("l_tax").alias("seconds"))
    return E.accuracy(rows).withColumn("accuracy", F.round("accuracy", 9)).withColumn("mean_seconds", F.round("mean_seconds", 9))


@r.query("e5_best_system", "SELECT system, accuracy, accuracy = max(accuracy) OVER () AND system = min(system) FILTER (true) OVER (PARTITION BY accuracy) AS best FROM (SELECT l_shipyear AS system, round(avg(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END), 9) AS accuracy FROM (SELECT *, CAST(l_linenumber AS VARCHAR) AS l_shipyear FROM lineitem) GROUP BY 1)")
def _(spark, d):
    rows = t(spark, d, "lineitem").select(F.col("l_linenumber").cast("string").alias("system"), (F.col("l_linestatus") == "F").alias("right"))
    return E.best_system(rows).withColumn("accuracy", F.round("accuracy", 9))


@r.query("e5_random_answers", "SELECT p_partkey AS id, (['A', 'B', 'C', 'D'])[1 + ('0x' || substr(md5(CAST(p_partkey AS VARCHAR)), 1, 8))::BIGINT % 4] AS predicted FROM part")
def _(spark, d):
    return E.random_answers(t(spark, d, "part").select(F.col("p_partkey").alias("id")), F.array(*map(F.lit, "ABCD")), F.col("id"))
