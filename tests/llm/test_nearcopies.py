"""Groups of near copies against brute force over all pairs' five-word shingles."""

import random

import pytest

import corpus_pipeline
from quern.llm import nearcopies

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def groups(texts):
    """{key: smallest key reachable} for {key: text}, by similarities of 4/5 and more."""
    sets = {k: shingles(t) for k, t in texts.items()}
    out = {k: k for k in texts}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and out[a] != out[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                low, high = sorted((out[a], out[b]))
                out = {k: low if c == high else c for k, c in out.items()}
    return out


def cases(texts):
    """Texts, copies with changed words, a chain of long lists whose ends differ, and a passage that many share."""
    rng = random.Random(1)
    words = sorted({w for t in texts for w in t.split()})[:3000]
    out = [*texts[:120], None, "", " \n", "one", "ONE", "one two", "a b c d e", "a b c d f"]
    for n in (20, 60, 200, 800):
        for _ in range(10):
            base = rng.choices(words, k=n)
            out.append(" ".join(base))
            for share in (0.01, 0.02, 0.03):
                out.append(" ".join(rng.choice(words) if rng.random() < share else w for w in base))
    chain = rng.choices(words, k=400)
    for i in range(60):
        chain[i * 6 : i * 6 + 6] = rng.choices(words, k=6)
        out.append(" ".join(chain))
    passage = rng.choices(words, k=50)
    out += [" ".join(rng.choices(words, k=rng.randrange(5, 30)) + passage) for _ in range(40)]
    return {i: t for i, t in enumerate(out)}


@pytest.mark.parametrize("held,many", [(nearcopies.HELD, 0), (0, 0), (nearcopies.HELD, nearcopies.MANY)])
def test_as_brute_force(spark, texts, held, many):
    given = cases(texts)
    want = groups(given)
    docs = spark.createDataFrame(list(given.items()), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in nearcopies.near_copies(docs, held, many).collect()} == want
    assert sorted(r["doc_id"] for r in nearcopies.deduplicated(docs).collect()) == [k for k, c in sorted(want.items()) if k == c]


def test_ids(spark):
    long = " ".join(map(str, range(300)))
    docs = spark.createDataFrame([(None, long), (1, long + " x"), (2, long), (2, long), (3, "other")], "doc_id long, text string")
    assert [r["doc_id"] for r in nearcopies.deduplicated(docs).orderBy("doc_id").collect()] == [None, 1, 3]
    assert nearcopies.deduplicated(docs.limit(0)).count() == 0


def test_rows_of_one_id(spark):
    """Each row of an id goes by its own text; equal rows are one; other columns may be called anything."""
    long, other = " ".join(map(str, range(300))), " ".join(map(str, range(1000, 1300)))
    rows = [(1, long, "a"), (2, long + " x", "b"), (2, other, "c"), (2, other, "c"), (3, other + " y", "d"), (4, None, "e"), (4, "", "f"), (None, long, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sig string").repartition(3)
    got = sorted(((r["doc_id"] or 0, r["text"] or "", r["sig"]) for r in nearcopies.deduplicated(docs).collect()))
    assert got[:3] == [(0, long, "g"), (1, long, "a"), (2, other, "c")] and len(got) == 4 and got[3][0] == 4


def test_stage(spark):
    """Documents 145 and 177 are near copies of 6 and 1 whose fingerprints are 7 and 11 bits apart."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = groups({r["doc_id"]: r["text"] for r in docs.collect()})
    kept = {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["simhash"](spark, docs, SF).collect()}
    assert kept == {k for k, c in want.items() if k == c} and not kept & {145, 177}


def test_fingerprints_come_first(spark, tmp_path):
    """Fingerprints find links that the texts bear out, and the shuffle files and texts of a run do not outlast it."""
    from pyspark.sql import functions as F

    from quern.llm import shared

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("doc_id < 600").dropDuplicates(["text"])
    texts = shared.stored(docs.select(F.col("doc_id").alias("sig"), "text"), "test-texts")
    by = {r["sig"]: {*nearcopies.shingles(r["text"].encode() if r["text"] else None).tolist()} for r in texts.collect()}
    links = nearcopies.fingerprint_links(texts).collect()
    assert links and all(5 * len(by[r["a"]] & by[r["b"]]) >= 4 * len(by[r["a"]] | by[r["b"]]) for r in links)
    shared.dropped(texts)
    with pytest.raises(Exception, match="not exist|FILE_NOT_EXIST|FileNotFound"):
        texts.collect()
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_pairs_far_apart_go_before_their_texts_are_read(spark, texts):
    """Maps drop no similar pair, and most of those that share a passage only."""
    given = cases(texts)
    sets = {k: nearcopies.shingles((t or "").encode()) for k, t in given.items()}
    keys = sorted(given)
    every = [(a, b) for a in keys for b in keys if a < b]
    similar = {(a, b) for a, b in every if nearcopies.similar(sets[a], sets[b])}
    mapped = nearcopies.maps(spark.createDataFrame(list(given.items()), "sig long, text string"))
    kept = {(r["a"], r["b"]) for r in nearcopies.possible(spark.createDataFrame(every, "a long, b long"), mapped).collect()}
    assert similar <= kept
    assert len(kept) < 2 * len(similar)


def test_maps_tell_long_texts_apart(spark):
    """Texts of thousands of words that share a passage go by their maps; long near copies stay, of unlike widths too."""
    rng = random.Random(2)
    text = lambda n: [str(rng.randrange(1 << 30)) for _ in range(n)]
    passage, base = text(100), text(4104)
    given = [passage + text(8000), passage + text(8200), base, base[:4050] + text(30), base[:4000] + text(900)]
    mapped = nearcopies.maps(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(given)], "sig long, text string"))
    every = [(a, b) for a in range(5) for b in range(a + 1, 5)]
    kept = {(r["a"], r["b"]) for r in nearcopies.possible(spark.createDataFrame(every, "a long, b long"), mapped).collect()}
    assert kept == {(2, 3), (2, 4), (3, 4)}
    assert len({len(r["map"]) for r in mapped.collect()}) > 1


def test_lists_are_told_by_maps_first(texts):
    """Groups hold every similar pair of two labels, and few others; a group that many lists have is one."""
    import numpy as np
    import pyarrow as pa

    given = cases(texts)
    sets = {k: nearcopies.shingles((t or "").encode()) for k, t in given.items()}
    sets = {k: h for k, h in sets.items() if len(h)}
    n, size = len(sets), [len(h) for h in sets.values()]
    label = [k % 7 for k in sets]
    one = pa.RecordBatch.from_arrays([pa.array([1] * n), pa.array(list(sets)), pa.array(size, pa.int32()), pa.array([s // 2 for s in size], pa.int32()), pa.array(label), pa.array(map(nearcopies.flips, sets.values()), pa.binary())], ["key", "sig", "size", "place", "label", "map"])
    two = one.set_column(0, "key", pa.array([2] * n))
    rows = [tuple(r.values()) for b in nearcopies.close_lists(iter([one.slice(0, 50), one.slice(50), two])) for r in b.to_pylist()]
    assert len(rows) == 2 * len(set(rows)) < 2 * n
    group = {sig: key for key, sig, _ in rows}
    similar = [(a, b) for a in sets for b in sets if a < b and a % 7 != b % 7 and nearcopies.may(*(np.array([x]) for x in (len(sets[a]), len(sets[a]) // 2, len(sets[b]), len(sets[b]) // 2)))[0] and nearcopies.similar(sets[a], sets[b])]
    assert similar and all(group[a] == group[b] for a, b in similar)
