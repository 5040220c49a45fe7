"""Each stage of the pipeline against brute force on what its predecessor kept."""

import hashlib
import re
from collections import Counter

import corpus_pipeline
from quern.llm import mixing, pretokens, toxicity
from test_nearcopies import groups
from test_substring import brute

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark):
    from tokenizers import Tokenizer

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "simhash", "substring", "mixing", "bpe"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumnRenamed("source", "source")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = {}
    given = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, given, SF)
        assert out.columns == docs.columns and out.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
        out = spark.createDataFrame(out.collect(), docs.schema)
        rows[name], given = out.collect(), out
    predicted = {r["doc_id"] for r in toxicity.toxicity(docs, labels).collect() if r["predicted"]}
    assert {r["doc_id"] for r in rows["toxicity"]} == {r["doc_id"] for r in docs.collect()} - predicted
    near = groups({r["doc_id"]: r["text"] for r in rows["toxicity"]})
    assert {r["doc_id"] for r in rows["simhash"]} == {d for d, c in near.items() if d == c}
    want = brute([(r["doc_id"], r["text"]) for r in rows["simhash"]], 50)
    before = {r["doc_id"]: r["text"] for r in rows["simhash"]}
    assert {r["doc_id"]: r["text"] for r in rows["substring"]} == {d: before[d] if not n else t for d, (_, n, t) in want.items() if not n or t}
    assert all(r["n_chars"] == len(r["text"]) for r in rows["substring"] if want[r["doc_id"]][1])
    # the mix: each source's words are its budget, documents whole but for one a source
    size = {r["doc_id"]: (r["source"], len(WORD.findall(r["text"]))) for r in rows["substring"]}
    total = Counter()
    for s, n in size.values():
        total[s] += n
    order = sorted(total, key=lambda s: s.encode())
    budget = dict(zip(order, mixing.targets([total[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))], 1.5, 2.0)))
    taken, cut = Counter(), Counter()
    for r in rows["mixing"]:
        n = len(WORD.findall(r["text"]))
        taken[r["source"]] += n
        cut[r["source"]] += n != size[r["doc_id"]][1]
    assert all(taken[s] == int(budget[s] + 0.5) and cut[s] <= 1 for s in order)
    library = Tokenizer.from_file(pretokens.default_vocabulary())
    got = Counter((r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in corpus_pipeline.STAGES[-1][1](spark, given, SF).collect())
    assert got == Counter((r["doc_id"], len(library.encode(r["text"], add_special_tokens=False).ids), hashlib.sha256(r["text"].encode()).hexdigest()) for r in rows["mixing"])


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_odd_rows(spark, rough_docs, tmp_path):
    """Null, empty and very long texts, repeated rows and null ids go through every stage, whatever else the columns are called."""
    docs = rough_docs.unionByName(rough_docs).unionByName(rough_docs.limit(3).selectExpr("CAST(NULL AS BIGINT) AS doc_id", *[f"`{c}`" for c in rough_docs.columns[1:]]))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(4, 1, 0), (5, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert rows and all(r["n_tokens"] > 0 for r in rows)
