"""Toxicity: gradients and responses against plain loops, held-out accuracy, defined results of odd rows."""

import zlib

import numpy as np
import pytest

from quern.llm import toxicity as tox

SF = "/root/testdata/sf0.1"


def test_responses_as_plain_loops():
    rng = np.random.default_rng(0)
    docs = [[b"w%d" % i for i in rng.integers(0, 30, n)] for n in (0, 1, 2, 3, 9, 0, 40)]
    filters = {w: rng.normal(size=(w, tox.SIZE, tox.FILTERS)) for w in tox.WIDTHS}
    m = tox.Model(rng.normal(size=(tox.TABLES * tox.BUCKETS, tox.SIZE)), filters, {w: rng.normal(size=tox.FILTERS) for w in tox.WIDTHS}, np.ones(tox.FILTERS * 3), 0.0)
    numbers = m.numbers()
    ids = numbers.of([w for d in docs for w in d])
    got = m.responses(numbers.rows, ids, np.array([len(d) for d in docs]))
    for d, row in zip(docs, got):
        v = [m.embed[b].sum(0) for b in tox.hashed(d)]
        for k, w in enumerate(tox.WIDTHS):
            runs = [sum(v[i + j] @ filters[w][j] for j in range(w)) + m.offsets[w] for i in range(len(d) - w + 1)]
            want = np.maximum(np.max(runs, axis=0), 0) if runs else np.zeros(tox.FILTERS)
            assert np.allclose(row[k * tox.FILTERS : (k + 1) * tox.FILTERS], want, atol=1e-4)


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = tox.toxicity(docs, labels).join(labels, "doc_id", "left").collect()
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    test = [r for r in rows if r["held_out"] and r["toxic"] is not None]
    hit = [r for r in test if r["toxic"] and r["predicted"]]
    assert len(hit) / sum(r["toxic"] for r in test) > 0.8
    assert len(hit) / sum(r["predicted"] for r in test) > 0.85


@pytest.mark.parametrize("ones", [[], [4]])
def test_rough(spark, rough_docs, ones):
    labels = spark.createDataFrame([(d, 1, int(d in ones)) for d in (1, 4, 5, 6, 8, 9)] + [(None, 1, 1), (7, 0, None), (99, 1, 1)], "doc_id long, quality int, toxic int")
    got = tox.toxicity(rough_docs, labels).collect()
    assert len(got) == 12 and all(0 <= r["score"] <= 1 for r in got)
    assert tox.toxicity(rough_docs.limit(0), labels).count() == 0
    assert tox.toxicity(rough_docs, labels.limit(0)).filter("score = 0").count() == 12
    assert tox.without_toxic(rough_docs, labels.limit(0)).count() == 12
    assert tox.without_toxic(rough_docs, labels).columns == rough_docs.columns


def test_runs_agree(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    a, b = (sorted(map(tuple, tox.toxicity(d, labels).collect())) for d in (docs, docs.repartition(5)))
    assert a == b


def test_fitted_away_from_the_driver(spark, monkeypatch):
    """The driver, which holds all else, never has the sample's texts."""

    from pyspark import TaskContext

    fit = tox.fit

    def here(*args, **how):
        assert not args[0] or TaskContext.get() is not None
        return fit(*args, **how)

    rows = [(i, ("bad worse words " if i % 2 else "fair weather here ") * 5, "en", i % 2) for i in range(80)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    monkeypatch.setattr(tox, "fit", here)
    assert tox.learn(docs, labels).languages == ["en"]
    assert tox.learn(docs, labels.limit(0)).constant == 0.0
