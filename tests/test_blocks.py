"""Vectors that are dealt to several blocks meet as those of one block do."""

import pytest

from quern.graph import similarity
from quern.operators import retrieval

SF = "/root/testdata/sf0.001"


@pytest.fixture
def apart(spark):
    """Partitions stay as they are dealt: small ones put together would hide keys that hash apart."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield spark
    spark.conf.set(name, before)


def test_similarity(apart):
    want = {(r["src"], r["dst"]) for r in similarity(apart, SF).edges.collect()}
    got = [(r["src"], r["dst"]) for r in similarity(apart, SF, block=60).edges.collect()]
    assert len(want) > 500 and set(got) == want and len(got) == len(want)


def test_semantic(apart):
    v = apart.read.parquet(f"{SF}/embeddings.parquet")
    plain = lambda rows: sorted((r["query_id"], r["place"], r["id"], round(r["score"], 9)) for r in rows.collect())
    want = plain(retrieval.semantic(v.filter("vec_id % 20 = 0"), v))
    assert len(want) == 125 and plain(retrieval.semantic(v.filter("vec_id % 20 = 0"), v, block=10)) == want
