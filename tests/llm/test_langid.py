"""Language ID: gradients against differences, held-out accuracy, defined results of odd rows."""

import zlib

import numpy as np

from quern.llm import langid


def test_gradients_through_time():
    rng = np.random.default_rng(1)
    layer = langid.Direction.fresh(rng)
    layer = langid.Direction(*(a.astype(np.float64) for a in (layer.byte, layer.gates, layer.new)))
    x = rng.integers(0, 6, (5, 7))
    weight = [rng.normal(size=(5, langid.STATE)) for _ in range(7)]
    loss = lambda: sum(float((s * w).sum()) for s, w in zip(layer.forward(x), weight))
    _, past = layer.forward(x, True)
    for p, g in zip((layer.byte, layer.gates, layer.new), layer.backward(x, past, weight)):
        for i in [tuple(rng.integers(0, n) for n in p.shape) for _ in range(12)] + [(3, 5)]:
            old, e = p[i], 1e-5
            p[i] = old + e
            up = loss()
            p[i] = old - e
            down = loss()
            p[i] = old
            assert abs((up - down) / (2 * e) - g[i]) < 1e-3 * max(1, abs(g[i]))


def some_model(rng):
    return langid.Model(["a", "b", "c"], langid.Direction.fresh(rng), langid.Direction.fresh(rng), rng.normal(size=(2 * langid.STATE, 3)).astype(np.float32), np.zeros(3, np.float32))


def test_pooling_as_plain_loops():
    """Lanes give what a window alone gives, whatever stands beside it; windows are whole texts here, or runs of them."""
    rng = np.random.default_rng(2)
    m = some_model(rng)
    docs = [b"one two one", b"", b"x" * 700, "日本語 é ".encode() * 90, *(bytes(rng.integers(32, 127, int(n)).tolist()) for n in rng.integers(1, 900, 150))]
    got = m.pooled(docs)
    for d, row in zip(docs, got):
        flat, starts, lengths, _ = langid.windows([d])
        assert b"".join(d[a : a + n] for a, n in zip(starts.tolist(), lengths.tolist())) == d
        parts = [m.positions(np.frombuffer(d[a : a + n], np.uint8)[None])[0] for a, n in zip(starts.tolist(), lengths.tolist())]
        assert np.allclose(row, np.concatenate(parts).mean(0) if parts else 0, atol=1e-5)
    assert (m.pooled(docs[::-1])[::-1] == got).all()


def test_windows_between_characters():
    for t in ("é" * 1000, "a" + "日本語" * 400, "x" * 256, "x" * 257):
        b = t.encode()
        _, starts, lengths, _ = langid.windows([b"ab", b, b""])
        own = starts >= 2
        for a, n in zip(starts[own].tolist(), lengths[own].tolist()):
            b[a - 2 : a - 2 + n].decode()
            assert n <= langid.WINDOW + 3


def test_states_run_on_across_words():
    m = some_model(np.random.default_rng(3))
    read = lambda t: m.positions(np.frombuffer(t, np.uint8)[None])[0]
    assert not np.allclose(read(b"der hund")[4:], read(b"the hund")[4:], atol=1e-6)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.languages(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    assert all((r["lang_pred"] == "und") == (not any(map(str.isalpha, r["text"]))) for r in rows)
    test = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in test) / len(test) > 0.97


def test_rough(spark, rough_docs):
    got = {r["doc_id"]: r for r in langid.languages(rough_docs).collect()}
    assert {d for d, r in got.items() if r["lang_pred"] == "und"} == {1, 2, 3}
    assert all(got[d]["score"] == 0 for d in (1, 2, 3)) and all(0 < r["score"] <= 1 for d, r in got.items() if d > 3)
    assert langid.languages(rough_docs.limit(0)).count() == 0
    none = langid.languages(rough_docs.withColumn("lang", rough_docs["lang"].substr(9, 1)).replace("", None)).collect()
    assert {(r["lang_pred"], r["score"]) for r in none} == {("und", 0.0)}
    one = langid.languages(rough_docs.replace(["de", "fr", "es"], "en", ["lang"])).collect()
    assert {r["lang_pred"] for r in one} == {"und", "en"}


def test_repeated_rows_and_ties(spark, texts):
    """Rows of one id get a row each; equal texts score alike; the sample stays bounded however often a row repeats."""
    from quern.llm.sampling import by_value

    rows = [(1, texts[3], "en")] * 50 + [(1, texts[4], "de")] * 50 + [(i, t, "en" if i % 2 else "de") for i, t in enumerate(texts)] + [(None, texts[3], "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    assert by_value(docs, "lang", 10, ["doc_id", "text"]).groupBy("lang").count().filter("count > 10").count() == 0
    got = langid.languages(docs).collect()
    assert len(got) == len(rows)
    assert len({(r["lang_pred"], r["score"]) for r in got if r["doc_id"] is None}) == 1
    same = langid.Model(["a", "b"], *(langid.Direction(*(0 * x for x in (d.byte, d.gates, d.new))) for d in [langid.Direction.fresh(np.random.default_rng(1))] * 2), np.zeros((2 * langid.STATE, 2), np.float32), np.zeros(2, np.float32))
    assert {(r["lang_pred"], r["score"]) for r in langid.predicted(docs, same).collect()} <= {("a", 0.5), ("und", 0.0)}
