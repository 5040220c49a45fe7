"""Evidence, tagging and descriptions on small cases."""

from quern.operators import evidence as V
from quern.operators import paths as P
from quern.sources import pages


def test_directed(spark):
    rows = [
        (1, "Ann", "Artist", "The E\\E (x", "Group", "MEMBER_OF", "Ann is a member of the E\\E (x today"),
        (2, "Ann", "Artist", "Blue", "Group", "MEMBER_OF", "Ann met Blue, a member of none"),
        (3, "Ann", "Artist", "Blue", "Group", "MEMBER_OF", "Blue gồm Ann"),
        (4, "Ann", "Artist", "Blue", "Group", "MEMBER_OF", "Ann, member" + " and so on" * 30 + " Blue"),
        (5, "Ann", "Group", "Blue", "Group", "MEMBER_OF", "Blue gồm Ann"),
        (6, "Ann", "Artist", "Blue", "Group", "UNKNOWN", "Blue gồm Ann"),
        (7, "", "Artist", "Blue", "Group", "MEMBER_OF", "Blue gồm Ann"),
        (8, None, "Artist", "Blue", "Group", "MEMBER_OF", "Blue gồm Ann"),
        (9, "Ann", "Artist", "Blue", "Group", "MEMBER_OF", None),
    ]
    df = spark.createDataFrame(rows, "id int, src string, src_type string, dst string, dst_type string, rel_type string, context string")
    assert sorted(r["id"] for r in V.directed(df).collect()) == [1, 3]
    only = {"MEMBER_OF": V.Evidence(("Artist",), ("Group",), 180, (), ("gồm",), only=("bob",))}
    assert V.directed(df, only).count() == 0


def test_parts_at_spaces():
    text = "word " * 1000
    parts = V.parts_at_spaces(text)
    assert [w for p in parts for w in p.split()] == ["word"] * 1000
    assert all(len(p) <= 2000 for p in parts)
    assert V.parts_at_spaces("x" * 4500) == ["x" * 2000, "x" * 2000, "x" * 500] and V.parts_at_spaces("") == []


def test_tagged(spark):
    say = [("(Ann)", "B-PER", 0.9), ("Big  Music", "ORG", 0.9), ("Blue", "organization", 0.99), ("new album", "MISC", 1.2), ("thing", "MISC", 0.9), ("far", "LOC", 0.9), ("low", "PER", 0.5), ("x", "PER", 0.9)]
    docs = spark.createDataFrame([(1, "some text"), (2, None), (3, "  ")], "doc_id long, text string")
    got = {(r["doc_id"], r["type"], r["text"]): r["confidence"] for r in V.tagged(docs, lambda parts: [say for _ in parts]).collect()}
    assert set(got) == {(1, "Artist", "Ann"), (1, "Company", "Big Music"), (1, "Group", "Blue"), (1, "Album", "new album")}
    assert got[1, "Album", "new album"] == 0.95
    assert V.tagged(docs.limit(0), lambda parts: []).count() == 0


def test_description():
    html = '<th class="infobox-header description">Bài hát của <a>An</a> và <a>Bo</a>, <a>An</a></th><th class="infobox-header description">từ album <a>album</a><a>C</a></th>'
    assert pages.description(html) == ("Bài hát của An và Bo, An", "An, Bo", "C")
    assert pages.description(None) == ("", "", None)


def test_named_pairs(spark):
    nodes = spark.createDataFrame([("b", "Ann"), ("a", "ANN"), ("c", "Bo")], "id string, title string")
    pairs = spark.createDataFrame([("ann", "BO"), ("ann", "none"), (None, "bo")], "src_name string, dst_name string")
    assert [tuple(r) for r in P.named_pairs(nodes, pairs).collect()] == [("a", "c")]
