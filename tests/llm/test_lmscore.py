"""LM scores against plain counts and sums over every segmentation."""

import math
import re
import zlib
from collections import Counter

import pytest

from quern.llm import lmscore


def cuts(s, weight):
    if not s:
        yield 1.0
    for n in range(1, len(s) + 1):
        if s[:n] in weight:
            for rest in cuts(s[n:], weight):
                yield weight[s[:n]] * rest


def test_forward_sums_all_cuts():
    pieces = (lmscore.MARK, lmscore.MARK + "th", "t", "h", "e", "th", "he", lmscore.MARK + "t", "the", "é")
    weight = {p: 0.9 / len(pieces) * (1 + i % 3) / 2 for i, p in enumerate(pieces)}
    lattice = lmscore.Lattice(pieces, [math.log(w) for w in weight.values()], [math.log(1e-4)] * 256)
    for w in ("the", "t", "thethe", "hehe", "éthe"):
        assert math.isclose(math.exp(lattice.forward(w)), sum(cuts(lmscore.MARK + w, weight)), rel_tol=1e-9)
    together = lattice.forwards(["the", "hehe", "tñ", "t"])
    assert [float(x) for x in together[:, 0]] == pytest.approx([lattice.forward(w) for w in ("the", "hehe", "tñ", "t")], rel=1e-12)
    assert math.isclose(lattice.forward("tñ"), lattice.forward("t") + 2 * math.log(1e-4), rel_tol=1e-9)
    assert lattice.forward("the" * 4000) > -1e6  # no underflow


def test_expected_counts():
    import numpy as np

    pieces = (lmscore.MARK, "a", "b", "ab", lmscore.MARK + "a")
    weight = dict(zip(pieces, (0.2, 0.2, 0.1, 0.3, 0.2)))
    lattice = lmscore.Lattice(pieces, [math.log(w) for w in weight.values()], [math.log(1e-4)] * 256)
    got = lmscore.expect(lattice, ["ab", "b"], np.array([[1.0, 0.0], [0.0, 2.0]]))
    assert np.allclose(got[:5, 1], [2, 0, 2, 0, 0])
    got = got[:5, 0]
    ways = {("▁", "a", "b"): 0.2 * 0.2 * 0.1, ("▁", "ab"): 0.2 * 0.3, ("▁a", "b"): 0.2 * 0.1}
    total = sum(ways.values())
    assert np.allclose(got, [sum(x for w, x in ways.items() if p in w) / total for p in pieces])


def test_words_weights_sum_to_one():
    """Over pieces that are single letters, with and without the mark."""
    pieces = (lmscore.MARK + "a", lmscore.MARK + "b", "a", "b")
    lattice = lmscore.Lattice(pieces, [math.log(x) for x in (0.3, 0.2, 0.4, 0.1)], [-50.0] * 256)
    lattice.letters |= {lmscore.MARK}
    words = [""]
    total = 0.0
    for _ in range(14):
        words = [w + c for w in words for c in "ab"]
        total += sum(math.exp(lattice.forward(w)) for w in words) if len(words[0]) < 12 else 0
    assert 0.99 < total <= 1


@pytest.mark.parametrize("unit", [400, 8_000_000])
def test_query_as_plain_counts(spark, rough_docs, unit):
    rows = rough_docs.collect()
    tokens = {r["doc_id"]: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or "")) for r in rows}
    out = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in tokens}
    c = Counter(w for d, t in tokens.items() if not out[d] for w in t)
    ends = sum(not x for x in out.values())
    n, v = sum(c.values()) + ends, len(c) + 1
    got = {r["doc_id"]: r for r in lmscore.scores(rough_docs, unit=unit).collect()}
    assert set(got) == set(tokens)
    for d, t in tokens.items():
        r = got[d]
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t) + math.log10((ends + 1) / (n + v + 1))
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out[d], len(t) + 1, sum(c[w] > 0 for w in t) + 1, n)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
        assert -1e7 < r["score"] < 0


def test_junk_scores_below_text(spark):
    """Words of random letters, as long as the held-out documents' words, are less likely than those."""
    import random

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = random.Random(3)
    held = [r for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2][:40]
    twins, at = [], 10**6
    for r in held:
        at = next(i for i in range(at + 1, at + 99) if zlib.crc32(str(i).encode()) % 7 == 2)
        twins.append((at, " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in w) for w in r["text"].split())))
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(twins, "doc_id long, text string"))
    got = {r["doc_id"]: r for r in lmscore.scores(both).collect()}
    assert len(got) == docs.count() + len(twins)
    assert all(got[t]["score"] < got[r["doc_id"]]["score"] for (t, _), r in zip(twins, held))


def test_empty(spark, rough_docs):
    assert lmscore.scores(rough_docs.limit(0)).count() == 0
    one = next(d for d in range(100) if zlib.crc32(str(d).encode()) % 7 == 2)
    (row,) = lmscore.scores(spark.createDataFrame([(one, "some words")], "doc_id long, text string")).collect()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"]) == (3, 0, 0, 0.0) and row["score"] < 0
    lattice = lmscore.Lattice(*lmscore.vocabulary_weights(lmscore.default_vocabulary()))
    alone = sum(lattice.forward(w) + math.log(1 - lmscore.END) for w in ("some", "words")) + math.log(lmscore.END)
    assert math.isclose(row["lattice_score"], alone / math.log(10), rel_tol=1e-6)


def test_repeated_rows_and_reruns(spark, rough_docs):
    """Rows of one id get a row each, equal rows equal scores, and scores do not depend on how rows are dealt."""
    twice = rough_docs.unionByName(rough_docs).unionByName(rough_docs.limit(2).selectExpr("CAST(NULL AS BIGINT) AS doc_id", *[f"`{c}`" for c in rough_docs.columns[1:]]))
    runs = [sorted((str(r["doc_id"]), r["n_tokens"], r["score"], r["lattice_score"]) for r in lmscore.scores(twice.repartition(k), unit=unit).collect()) for k, unit in ((1, 8_000_000), (5, 300))]
    assert len(runs[0]) == 26 and runs[0] == runs[1]


def test_packed_numbers():
    import numpy as np

    for ids, counts in (([], []), ([0], [1]), ([3, 70000, 70001, 300000], [1, 255, 256, 1000]), ([65535, 131070], [254, 510])):
        i, k = lmscore.unpacked(*lmscore.packed(np.array(ids, np.int64), np.array(counts, np.int64)))
        total = {}
        for a, b in zip(i.tolist(), k.tolist()):
            total[a] = total.get(a, 0) + b
        assert {a: b for a, b in total.items() if b} == dict(zip(ids, counts))


def test_urns_as_draws_one_by_one():
    import numpy as np

    p = {"a": 0.6, "b": 0.3, "c": 1e-7}
    text = ["a", "c", "b", "c", "c", "a"]
    got = lmscore.urns(np.log([[p[w]] for w in p]), np.array([text.count(w) for w in p]))
    for row, s in zip(got[:, 0], (math.inf, *lmscore.STRENGTHS)):
        want = math.prod(p[w] if s == math.inf else (s * p[w] + text[:i].count(w)) / (s + i) for i, w in enumerate(text))
        assert math.isclose(math.exp(row), want / (1 + len(lmscore.STRENGTHS)), rel_tol=1e-7)
    none = lmscore.urns(np.zeros((0, 2)), np.zeros(0, np.int64))
    assert np.allclose(none, -math.log(1 + len(lmscore.STRENGTHS)))


def test_held_out_beats_base(spark):
    """Where training is large enough; on a small corpus the base's add-one share of unseen words flatters it."""
    rows = lmscore.scores(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).filter("held_out").collect()
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_every_round_is_fitted_on_all_words(spark):
    """More words than any bounded sample took: the weights are those of the same rounds over all of them."""
    import itertools

    import numpy as np

    made = sorted("".join(w) for w in itertools.product("abcdefghijklm", repeat=4))
    assert len(made) > 20_000
    rows = spark.createDataFrame([(bytearray(w.encode()), 1, 1) for w in made], "word binary, c long, c0 long")
    path = lmscore.default_vocabulary()
    first = shared = lmscore.Lattice(*lmscore.vocabulary_weights(path))
    for _ in range(4):
        shared = lmscore.reweighted(first, lmscore.expect(shared, made, np.ones((len(made), 1))))
    got = lmscore.fit(rows, 1, path)
    assert np.allclose(got.weights[-1], shared.weights[0], rtol=0, atol=1e-9)


def test_documents_together_as_one_by_one(monkeypatch):
    """Several documents' words are summed up at once, those of empty and of longest ones too."""
    import numpy as np

    monkeypatch.setattr(lmscore, "TOGETHER", 40)
    rng = np.random.default_rng(3)
    sizes = [0, 5, 0, 0, 90, 1, 30, 9, 0]
    ids = [np.sort(rng.choice(300_000, n, replace=False)) for n in sizes]
    counts = [rng.choice([1, 2, 7, 700], n) for n in sizes]
    logs = np.log(rng.random((300_000, 2)) / 1000)
    seen = 0
    for a, b, i, k, starts in lmscore.several(*zip(*(lmscore.packed(x, y) for x, y in zip(ids, counts)))):
        together = lmscore.urns_of(logs[i], k, starts)
        assert a == seen and len(starts) == b - a + 1
        for d in range(a, b):
            x, y = lmscore.unpacked(*lmscore.packed(ids[d], counts[d]))
            assert np.array_equal(i[starts[d - a] : starts[d - a + 1]], x) and np.array_equal(k[starts[d - a] : starts[d - a + 1]], y)
            np.testing.assert_allclose(together[:, d - a], lmscore.urns(logs[x], y), rtol=1e-12, atol=1e-9)
        seen = b
    assert seen == len(sizes)
