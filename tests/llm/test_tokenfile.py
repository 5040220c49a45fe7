"""Token files against the library, and views against what was written."""

import zlib

import numpy as np
import pytest

from quern.llm import pretokens, tokenfile
from odd_texts import ODD


@pytest.fixture(scope="module")
def library():
    return tokenfile._library(pretokens.default_vocabulary())


def test_encoder_as_the_library(library, texts):
    rows = [*ODD, *texts]
    coder = tokenfile.Encoder(pretokens.default_vocabulary())
    for _ in range(2):  # with an empty memo and a filled one
        got = [np.frombuffer(x, coder.kind).tolist() for x in coder.encode(rows).to_pylist()]
        assert got == [e.ids for e in library.encode_batch(rows, add_special_tokens=False)]


def brute(library, docs):
    want, start = {}, 0
    for r in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        want[r["doc_id"]] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    return want


@pytest.mark.parametrize("file_bytes", [1000, 1 << 26])
def test_files(spark, library, rough_docs, file_bytes, monkeypatch):
    monkeypatch.setattr(tokenfile, "STRIDE", 2)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokenfile.write_and_read(rough_docs, file_bytes=file_bytes).collect()}
    assert got == brute(library, rough_docs)
    assert (len(tokenfile.write(rough_docs, file_bytes=file_bytes)[1]) > 2) == (file_bytes == 1000)


def test_other_ids(spark):
    with pytest.raises(KeyError):
        tokenfile.write(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_views(spark, rough_docs):
    _, manifest = tokenfile.write(rough_docs)
    file = tokenfile.Reader(manifest[0]["uri"])
    ids, mask = file.sequence(0)
    assert len(ids) == len(mask) == tokenfile.LENGTH
    assert not ids.flags.owndata
    assert sum(file.sequence(i)[1].true_count for i in range(len(file))) == manifest[0]["tokens"]


def test_runs_across_batches(tmp_path):
    import pyarrow as pa

    rng, size = np.random.default_rng(1), tokenfile.LENGTH * tokenfile.ROWS
    rows = [rng.integers(0, 50000, n).astype("<u2") for n in (5, size - 3, 2 * size + 9, 1, size)]
    w = tokenfile.Writer(f"file://{tmp_path}/a/x.arrows", np.dtype("<u2"), pa.int64())
    w.add(pa.array([1, 2], pa.int64()), [x.tobytes() for x in rows[:2]])
    w.add(pa.array([3, 4, 5], pa.int64()), [x.tobytes() for x in rows[2:]])
    w.close()
    file, at = tokenfile.Reader(f"file://{tmp_path}/a/x.arrows"), 0
    assert all(b.num_rows == tokenfile.ROWS for b in file.batches[:-1])
    for x in rows:
        assert (file.run(at, len(x)) == x).all()
        at += len(x)


def test_nulls_and_empty(spark, rough_docs):
    assert tokenfile.write_and_read(rough_docs.limit(0)).count() == 0
    twice = spark.createDataFrame([(None, "a b"), (7, "c"), (7, "c"), (None, None)], "doc_id long, text string")
    got = sorted((r["start"], r["doc_id"]) for r in tokenfile.write_and_read(twice).collect())
    assert [g[1] for g in got] == [None, None, 7, 7]
    assert [g[0] for g in got] == [0, 1, 4, 6]
