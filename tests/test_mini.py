"""Names, years, infoboxes and small graphs whose answers are plain to see."""

import math

import pytest
from pyspark.sql import functions as F

from quern.functions import names as N
from quern.graph import Graph
from quern.operators import analytics as A
from quern.operators import communities as C
from quern.operators import crawl, extraction, paths, reasoning, resolution
from quern.operators import lookups as K
from quern.sources import graphfile, pages

NODES = [("Ana (singer)", "Artist"), ("Bo-ram", "Artist"), ("Cy", "Artist"), ("Duo", "Group"), ("Duo-X", "Group"), ("Trio", "Group"), ("Company_Alpha", "Company"), ("Company_Beta", "Company"), ("Genre_Pop", "Genre"), ("One", "Album"), ("Song A", "Song"), ("Lone", "Artist")]
EDGES = [("Ana (singer)", "Duo", "MEMBER_OF", 1.0), ("Bo-ram", "Duo", "MEMBER_OF", 0.6), ("Cy", "Trio", "MEMBER_OF", 1.0), ("Duo", "Company_Alpha", "MANAGED_BY", 1.0), ("Duo-X", "Company_Alpha", "MANAGED_BY", 1.0), ("Trio", "Company_Beta", "MANAGED_BY", 1.0), ("Duo", "Company_Beta", "MANAGED_BY", 1.0), ("Duo-X", "Duo", "SUBUNIT_OF", 1.0), ("One", "Song A", "CONTAINS", 1.0), ("Ana (singer)", "Song A", "SINGS", 1.0), ("Ana (singer)", "Song A", "WROTE", 1.0), ("Duo", "Genre_Pop", "IS_GENRE", 1.0), ("Trio", "Genre_Pop", "IS_GENRE", 1.0)]


@pytest.fixture(scope="module")
def mini(spark):
    return Graph(spark.createDataFrame([(i, x, i) for i, x in NODES], "id string, label string, title string"), spark.createDataFrame(EDGES, "src string, dst string, rel_type string, confidence double"))


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def one(spark, f, *values):
    cols = [F.lit(v) for v in values]
    return spark.range(1).select(f(*cols)).first()[0]


def test_names(spark):
    assert one(spark, N.display, "Ana (singer)") == "Ana"
    assert one(spark, N.without_role, "MIN (CA SĨ)") == "MIN"
    assert one(spark, N.compare_key, "Bo-Ram Kim (ca sĩ)") == "boramkim"
    assert one(spark, N.mention, "K-pop Black-Pink (nhóm") == "Black Pink"
    assert one(spark, N.folded, "Năm thành lập (Đầu)") == "nam_thanh_lap_dau"
    assert one(spark, N.first_year, "2013–nay") == 2013 and one(spark, N.first_year, "20122016–nay") == 2016 and one(spark, N.first_year, "10 tháng 9 năm 2021") == 2021
    assert one(spark, N.year_range, "2013–2016, 2015") == "2013–2016" and one(spark, N.year_range, "nay") is None
    assert one(spark, N.genre, "hip hop") == "Hip-hop" and one(spark, N.genre, "K-pop") == "" and one(spark, N.genre, "soft rock") == "Soft Rock"
    assert one(spark, N.has_hangul, "한국") and not one(spark, N.has_hangul, "Han")
    assert one(spark, N.split_list, "An, Binh và Chi & Dung; Em") == ["Binh", "Chi", "Dung"]
    assert one(spark, N.split_list, "Binh, Chi, and Dung,Phuc") == ["Binh", "Chi", "Dung", "Phuc"]
    assert one(spark, N.split_list, "Binh, and and the") == ["Binh", "and", "the"]


def test_look_ups(mini, spark):
    assert rows(K.members(mini, label="Artist")) == [("Duo", "Ana (singer)"), ("Trio", "Cy")]
    assert rows(K.resolve(mini, spark.createDataFrame([("pop",), ("Pop",), ("Genre_Pop",), ("no",)], "name string"))) == [("Genre_Pop", "Genre_Pop"), ("Pop", "Genre_Pop"), ("no", None), ("pop", "Genre_Pop")]
    assert ("Duo", "Trio", "Company_Beta") in rows(reasoning.sharing(mini, "MANAGED_BY"))
    assert {m for i, m in rows(reasoning.mates(mini, "MANAGED_BY")) if i == "Duo"} == {"Duo-X", "Trio"}
    assert rows(reasoning.getter(mini, "SUBUNIT_OF", backwards=True)) == [("Duo", "Duo-X")]
    assert rows(reasoning.getter(mini, "CONTAINS")) == [("One", "Song A")]
    assert rows(reasoning.sharing(mini, "IS_GENRE")) == [("Duo", "Trio", "Genre_Pop")]
    assert {r[2] for r in rows(mini.edges.filter("dst = 'Song A' AND src LIKE 'Ana%'"))} == {"SINGS", "WROTE"}
    assert rows(crawl.sub_units(mini.nodes.filter("label = 'Group'"))) == [("Duo-X", "Duo")]
    cy = spark.createDataFrame([("Cy",)], "id string")
    assert rows(reasoning.direct_or_via(mini, cy, "MANAGED_BY", "MEMBER_OF")) == [("Cy", "Company_Beta")]


def test_paths(mini, spark):
    e = paths.both_ways(mini.edges.select("src", "dst"))
    pairs = spark.createDataFrame([("Cy", "Duo"), ("Cy", "Lone"), ("Cy", "Cy")], "src string, dst string")
    assert [(r["src"], r["dst"], r["hops"]) for r in paths.shortest_paths(e, pairs).orderBy("hops").collect()] == [("Cy", "Cy", 0), ("Cy", "Duo", 3)]
    assert {tuple(r["path"]) for r in paths.shortest_paths(e, pairs.filter("dst = 'Duo'"), every=True).collect()} == {("Cy", "Trio", "Company_Beta", "Duo"), ("Cy", "Trio", "Genre_Pop", "Duo")}


def test_analytics(spark, mini):
    u = mini.undirected()
    assert dict(rows(A.components(mini.nodes, u)))["Lone"] == "Lone"
    assert dict(rows(A.clustering(mini.nodes, u)))["Lone"] == 0
    line = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (2, 4)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5)], "id long")
    got = dict(rows(A.betweenness(nodes, line)))
    assert math.isclose(got[2], 2 * 2 / (4 * 3)) and got[1] == got[3] == got[4] == got[5] == 0
    ranks = dict(rows(A.pagerank(nodes, line, rounds=60)))
    assert math.isclose(sum(ranks.values()), 1, rel_tol=1e-9) and max(ranks, key=ranks.get) == 2
    assert rows(A.triangles(line)) == [(2, 3, 4)]


def test_communities(spark):
    two = [(a, b) for c in (0, 10) for a in range(c, c + 5) for b in range(a + 1, c + 5)] + [(4, 10)]
    pairs = spark.createDataFrame(two, "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in [*range(5), *range(10, 15)]], "id long")
    want = {0: set(range(5)), 10: set(range(10, 15))}
    for find in (C.louvain, C.greedy_modularity, C.girvan_newman):
        found = {}
        for i, c in rows(find(nodes, pairs)):
            found.setdefault(c, set()).add(i)
        assert found == want
    q = C.modularity(nodes, pairs, C.louvain(nodes, pairs)).first()
    assert q["communities"] == 2 and math.isclose(q["modularity"], 2 * (10 / 21 - (21 / 42) ** 2))
    assert len({c for _, c in rows(C.k_cliques(pairs))}) == 2


def test_infobox(spark):
    html = '<p>x</p><table class="infobox vcard"><tr><th>Thành viên</th><td><a href="/a">Ana</a><sup>[1]</sup><br><a href="/b">Bo</a></td></tr><tr><th>Năm hoạt động</th><td>2013–nay[2]</td></tr><tr><th>Ghi chú</th><td>PopRock<ul><li>a</li><li>b</li></ul></td></tr></table><table><tr><th>no</th><td>x</td></tr></table>'
    assert pages.infobox(html) == {"Thành viên": "Ana, Bo", "Năm hoạt động": "2013–nay", "Ghi chú": "Pop Rock, a, b"}
    df = pages.infoboxes(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string"))
    assert rows(pages.member_fields(df)) == [(1, {"Current members": "Ana, Bo"})]


def test_mentions(spark):
    docs = spark.createDataFrame([(1, "The New York Times of New York, play Lay."), (2, "nothing")], "doc_id long, text string")
    names = spark.createDataFrame([("New York", "Place"), ("New York Times", "Paper"), ("Lay", "Artist")], "name string, type string")
    assert [(r["name"], r["start"]) for r in extraction.by_dictionary(docs, names).orderBy("start").collect()] == [("New York Times", 1), ("New York", 5), ("Lay", 8)]
    spans = spark.createDataFrame([(1, 1, 5, "a"), (1, 154, 160, "b"), (1, 155, 160, "c"), (1, 156, 160, "d")], "doc_id long, start int, end int, name string")
    assert {r["second"] for r in extraction.near_pairs(spans).filter("first = 'a'").collect()} == {"b", "c"}


def test_claims_and_graph_file(spark, tmp_path):
    nodes = spark.createDataFrame([("A", "Artist", "A"), ("B", "Artist", "B")], "id string, label string, title string")
    found = spark.createDataFrame([("A", "Group"), ("B", "Artist"), ("C", "Song"), ("C", "Group")], "text string, type string")
    assert rows(resolution.claimed(nodes, found)) == [("A (Group)", "Group", "A"), ("C (Song)", "Song", "C"), ("C", "Group", None)]
    (tmp_path / "g.json").write_text('{"nodes": {"x": {"label": "Song"}, "y": {"label": "Album", "title": "Why"}}, "edges": [{"source": "x", "target": "y", "type": "PRODUCED_SONG", "properties": {"confidence": "0.5"}}, {"source": "x", "target": "y", "type": "PRODUCE_SONG"}]}')
    g = graphfile.load(spark, str(tmp_path / "g.json"))
    assert rows(g.nodes.select("id", "title")) == [("x", "x"), ("y", "Why")] and g.edges.count() == 1
    assert graphfile.load_if_there(spark, str(tmp_path / "none.json"), "id string").count() == 0
