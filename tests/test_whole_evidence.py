"""Relations anywhere in a text."""

from quern import plans
from quern.operators import evidence as V
from quern.operators import extraction as X

SF = "/root/testdata/sf0.001"


def test_pairs_in_context(spark):
    far = "word " * 200
    docs = spark.createDataFrame([(1, far + "Ann met the Duo " + far), (2, far + "Ann " + far + "the Duo"), (3, None), (4, "Duo of the Ann")], "doc_id long, text string")
    names = spark.createDataFrame([("Ann", "Artist"), ("Duo", "Group")], "name string, type string")
    spans = X.tokens(docs).withColumnRenamed("word", "name").join(names, "name")
    pairs = V.pairs_in_context(docs, spans, 40)
    assert sorted(tuple(r) for r in pairs.filter("src = 'Ann'").select("doc_id", "dst", "context").collect()) == [(1, "Duo", "Ann met the Duo"), (4, "Duo", "Duo of the Ann")]
    assert pairs.count() == 4


def test_query(spark):
    kind = {"thing": "Artist", "that": "Artist", "for": "Group", "ou": "Group", "the": "Album"}
    want, late = set(), 0
    for doc in spark.read.parquet(f"{SF}/documents.parquet").collect():
        at, spots = 0, []
        for w in (doc["text"] or "").split(" "):
            if w in kind:
                spots.append((at, w))
            at += len(w) + 1
        for i, (p, x) in enumerate(spots):
            for q, y in spots[i + 1 :]:
                if q - p > 40:
                    break
                context = doc["text"][p : q + len(y)].lower()
                for s, t in ((x, y), (y, x)):
                    a, b = context.find(s), context.find(t)
                    between, words = context[min(a, b) : max(a, b)], context.split()
                    if s == t or abs(a - b) > (15 if kind[t] == "Album" else 40):
                        continue
                    if kind[s] == "Artist" and kind[t] == "Group" and ("the" in between or (len(words) == 4 and words[0] == s)):
                        want.add((doc["doc_id"], s, "MEMBER_OF", t))
                        late += p > 300
                    if kind[s] in ("Artist", "Group") and kind[t] == "Album" and "de" in between:
                        want.add((doc["doc_id"], s, "RELEASED", t))
    got = plans.queries()["x4_directed"](spark, SF).collect()
    assert len(got) == len({tuple(r) for r in got}) and {tuple(r) for r in got} == want and late
