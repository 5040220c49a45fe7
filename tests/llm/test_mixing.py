"""Mixing against a plain loop over hash-ordered documents."""

import hashlib
import re

import pytest

from quern.llm import mixing


def plain(rows):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, _, t in rows]
    sources = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, (s or "").encode()))
    own = {s: [i for i, r in enumerate(rows) if r[1] == s] for s in sources}
    totals = [sum(size[i] for i in own[s]) for s in sources]
    target = dict(zip(sources, mixing.targets(totals, [(3, 1, 2)[k % 3] for k in range(len(sources))], 1.5, 2.0)))
    out = {}
    for s, whole in zip(sources, totals):
        left = int(target[s] + 0.5)
        order = sorted(own[s], key=lambda i: (hashlib.md5(str(rows[i][0]).encode()).hexdigest()[:15], rows[i][0]))
        taken = {i: 0 for i in order}
        while left and whole:
            for i in order:
                n = min(left, size[i])
                taken[i] += n
                left -= n
        for i in order:
            out[rows[i][0]] = (size[i], whole, target[s], taken[i])
    return out


@pytest.mark.parametrize("range_rows", [2000, 4])
def test_as_a_plain_loop(spark, texts, range_rows):
    rows = [(i, f"s{i * i % 7 if i % 3 else 0}", t) for i, t in enumerate(texts)] + [(1000, None, "a b c"), (1001, "zero", ""), (1002, "zero", None), (1003, "é", "x" * 999 + " y"), (1004, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    got = {r["doc_id"]: (r["size"], r["source_size"], r["target"], r["taken"]) for r in mixing.mix(df, range_rows=range_rows).collect()}
    want = plain(rows)
    assert set(got) == set(want)
    for d, x in want.items():
        assert got[d][:2] == x[:2] and got[d][3] == x[3] and abs(got[d][2] - x[2]) < 1e-6
        assert got[d][3] <= 2 * got[d][0]


@pytest.mark.parametrize("range_rows", [2000, 2])
def test_reruns_agree_on_repeated_ids(spark, range_rows):
    """Rows of one id, or without one, take the same however they are dealt; equal rows share their words."""
    rows = [(7, "s", " ".join(f"w{i}" for i in range(n))) for n in (3, 7, 11, 40, 50, 90)] + [(7, "s", "x y z")] * 9 + [(None, "t", f"a {i}") for i in range(80)] + [(None, "t", "b c d")] * 5 + [(1, "u", "q " * 400)]
    seen = set()
    for k in (1, 2, 5):
        for some in (rows, rows[::-1]):
            df = spark.createDataFrame(some, "doc_id long, source string, text string").repartition(k)
            got = mixing.mix(df, range_rows=range_rows).collect()
            assert len(got) == len(rows)
            seen.add(tuple(sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in got)))
            for s in "stu":
                assert sum(r["taken"] for r in got if r["target"] == next(x["target"] for x in got if x["size"] == {"s": 90, "t": 2, "u": 400}[s])) == int(next(x["target"] for x in got if x["size"] == {"s": 90, "t": 2, "u": 400}[s]) + 0.5)
    assert len(seen) == 1


def test_mixture_meets_the_budget(spark):
    """Repeated and null ids come as often as their words are taken, and no oftener."""
    rows = [(7, "s", " ".join(f"w{i}" for i in range(n)), "en") for n in (3, 7, 11, 40)] + [(7, "s", "x y z", "de")] * 4 + [(None, "t", "b c d", "en")] * 5 + [(None, None, "e f", "en"), (2, None, None, "en"), (3, "u", "q " * 60, "fr")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, lang string").repartition(3)
    target = {r["source"]: int(r["target"] + 0.5) for r in mixing._placed(df, mixing.F.lit(0), (3, 1, 2), 1.5, 2.0, 2000).collect()}
    got = mixing.mixture(df).collect()
    for s, words in target.items():
        assert sum(len(r["text"].split()) for r in got if r["source"] == s) == words


def test_targets_stop_at_twice_the_size():
    t = mixing.targets([10, 1000, 1000], [3, 1, 2], 1.5, 2.0)
    assert t[0] == 20 and abs(sum(t) - 3015) < 1e-9 and abs(t[2] - 2 * t[1]) < 1e-9 or t[2] == 2000
    assert mixing.targets([0, 0], [1, 1], 1.5, 2.0) == [0.0, 0.0] and mixing.targets([], [], 1.5, 2.0) == []


def test_rough(spark, rough_docs):
    assert mixing.mix(rough_docs).count() == 12
    assert mixing.mix(rough_docs.limit(0)).count() == 0
    assert mixing.mixture(rough_docs).columns == rough_docs.columns
    twice = rough_docs.unionByName(rough_docs)
    rows = mixing.mix(twice).collect()
    assert len(rows) == 24 and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
