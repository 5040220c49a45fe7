"""BPE against the tokenizers library, and exact round trips."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import bpe, pretokens
from odd_texts import ODD

@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(pretokens.default_vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


def test_texts_as_the_library(library, texts):
    rows = [*ODD, *texts]
    got = bpe.Encoder(pretokens.default_vocabulary()).encode(rows)
    want = [e.ids for e in library.encode_batch(rows, add_special_tokens=False)]
    assert [x.tolist() for x in got] == want
    table = pretokens.token_bytes(pretokens.default_vocabulary())
    assert [bpe.decode(x, table).decode() for x in got] == [library.decode(x, skip_special_tokens=False) for x in want]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60), st.text(alphabet=" \n\tab'sé1.", max_size=40))
def test_any_text(library, a, b):
    rows = [a, b, a + b]
    got = bpe.Encoder(pretokens.default_vocabulary()).encode(rows)
    assert [x.tolist() for x in got] == [e.ids for e in library.encode_batch(rows, add_special_tokens=False)]


def test_lexicon_holds_its_words_and_no_others(tmp_path):
    words = {w.encode(): np.arange(i % 4, dtype=np.int32) + i for i, w in enumerate(sorted({f"{a}{b}{c}" for a in ("", "th", "ing", "x") for b in ("e", "in", "er", "é") for c in ("", "s", "ing")}))}
    bpe.Lexicon.built(words).save(f"file://{tmp_path}/l/words.arrow")
    got = bpe.Lexicon.mapped(f"file://{tmp_path}/l/words.arrow")
    assert len(got.first) - 1 < sum(map(len, words)) / 2  # suffixes are shared
    for n in {*map(len, words), 3, 7}:
        group = [w for w in words if len(w) == n] + [b"q" * n]
        found, rest = got.look_up(group, n)
        assert rest == [b"q" * n]
        assert all((found[w] == words[w]).all() for w in group[:-1])
    assert bpe.Lexicon.built({}).look_up([b"a"], 1) == ({}, [b"a"])


def test_query(spark, library, rough_docs):
    got = {r["doc_id"]: r for r in bpe.encode_decode(rough_docs).collect()}
    assert len(got) == rough_docs.count()
    for r in rough_docs.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        row = got[r["doc_id"]]
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()


def test_empty_table(spark, rough_docs):
    assert bpe.encode_decode(rough_docs.limit(0)).count() == 0
