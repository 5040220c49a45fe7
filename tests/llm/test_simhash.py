"""SimHash groups against brute force over all pairs."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from quern.llm import simhash
from quern.llm.components import components, forest


def plain(text, words=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    rows = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or ([" ".join(w)] if w else [])
    h = [xxh64_intdigest(r.encode(), 42) for r in rows]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(prints):
    """{key: smallest key reachable} for {key: fingerprint}."""
    out = {k: k for k in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 3 and out[a] != out[b]:
                    out[a] = out[b] = min(out[a], out[b])
                    changed = True
    return out


def test_fingerprints(texts):
    rows = [*texts[:60], None, "", " \t", "One", "one TWO", "É a\x0bb\x85c d"]
    assert simhash.fingerprint([t if t is None else t.encode() for t in rows]).tolist() == [plain(t) for t in rows]


def test_query_as_brute_force(spark, rough_docs, texts):
    more = [(100 + i, t) for i, t in enumerate(texts[:80])] + [(300, texts[5] + " tail"), (301, texts[5].upper()), (302, texts[7].replace("the", "teh", 1))]
    docs = rough_docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    prints = {r["doc_id"]: plain(r["text"]) for r in docs.collect()}
    want = groups(prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == {k: (f"{prints[k]:016x}", want[k]) for k in prints}
    kept = {r["doc_id"] for r in simhash.deduplicated(docs).collect()}
    assert kept == {k for k in prints if want[k] == k}


@pytest.mark.parametrize("long", [2, 40, 5000])
def test_clustered_fingerprints(spark, long, monkeypatch):
    monkeypatch.setattr(simhash, "LONG", 4 if long == 2 else simhash.LONG)
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    flips = lambda n: np.bitwise_xor.reduce(np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64))
    bits = {int(c ^ flips(int(rng.integers(1, 5)))) for c in centre for _ in range(40)} | {0, 1 << 63, (1 << 64) - 1}
    bits |= {int(centre[0]) ^ (x & 0xFFFFFF) for x in range(0, 1 << 24, 99991)}
    prints = {i: b for i, b in enumerate(sorted(bits))}
    want = groups(prints)
    signed = {b - (1 << 64) if b >> 63 else b: i for i, b in prints.items()}
    links = simhash.near_pairs(spark.createDataFrame([(b,) for b in signed], "bits long"), long=long)
    for r in links.collect():
        assert (prints[signed[r["a"]]] ^ prints[signed[r["b"]]]).bit_count() <= 3 or want[signed[r["a"]]] == want[signed[r["b"]]]
    got = {}
    for r in components(links).collect():
        got.setdefault(r["root"], set()).add(signed[r["node"]])
    sets = {}
    for k, v in want.items():
        sets.setdefault(v, set()).add(k)
    assert sorted(map(sorted, got.values())) == sorted(sorted(s) for s in sets.values() if len(s) > 1)


def test_every_level_reaches_every_pair():
    rng = np.random.default_rng(5)
    for level in (3, 4, 5):
        for _ in range(300):
            x = int(rng.integers(0, 1 << 63))
            y = x ^ sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
            assert any(x & m == y & m for m in simhash.masks(level, 3))


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 6000 + i) for i in range(50)] + [(7, 7)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    got = {r["node"]: r["root"] for r in components(df).collect()}
    a, b = np.array([e for e in edges if e[0] != e[1]]).T
    child, root = forest(a, b)
    want = dict(zip(child.tolist(), root.tolist())) | {r: r for r in root.tolist()}
    assert got == want
    assert components(df.filter("a < 0")).count() == 0


def test_empty_and_repeated(spark, rough_docs):
    assert simhash.near_duplicates(rough_docs.limit(0)).count() == 0
    twice = rough_docs.select("doc_id", "text").unionByName(rough_docs.select("doc_id", "text"))
    assert simhash.near_duplicates(twice).count() == 24
    null = rough_docs.select(F.lit(None).cast("long").alias("doc_id"), "text")
    assert simhash.near_duplicates(null).count() == 12
    assert simhash.deduplicated(null).count() == 12
