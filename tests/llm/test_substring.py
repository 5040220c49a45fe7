"""Substring dedup against brute force over every window."""

import hashlib
import re

import numpy as np
import pytest

from quern.llm import substring


def brute(rows, k):
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in rows}
    first = {}
    for d in sorted(x for x in words if x is not None):
        for i in range(len(words[d]) - k + 1):
            first.setdefault(tuple(words[d][i : i + k]), d)
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - k + 1):
            if d is not None and first[tuple(w[i : i + k])] < d:
                gone.update(range(i, i + k))
        left = [x for i, x in enumerate(w) if i not in gone]
        out[d] = (len(w), len(gone), " ".join(left))
    return out


def check(spark, rows, k, hot):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows, k)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"], r["kept_sha256"]) for r in substring.without_repeats(docs, k, hot, keep_text=True).collect()}
    assert got == {d: (*x, hashlib.sha256(x[2].encode()).hexdigest()) for d, x in want.items()}
    trimmed = {r["doc_id"]: r["text"] for r in substring.trimmed(docs, k, hot).collect()}
    assert trimmed == {d: (t if not want[d][1] else want[d][2]) for d, t in rows if not want[d][1] or want[d][2]}
    return sum(x[1] for x in want.values())


@pytest.mark.parametrize("hot", [500, 2])
def test_passages(spark, hot):
    rng = np.random.default_rng(4)
    word = lambda n: " ".join(rng.choice(["the", "of", "a", "x1", "y2", "z3", "é", "q."], n))
    passages = [word(n) for n in (12, 30, 9, 70)]
    rows = [(i, f"{word(int(rng.integers(0, 25)))} {passages[int(rng.integers(0, 4))]}\n{word(int(rng.integers(0, 9)))}") for i in range(60)]
    rows += [(100, "same " * 400), (101, "same " * 300 + "end"), (102, rows[5][1]), (103, rows[5][1]), (104, None), (105, ""), (None, rows[5][1]), (99, " " + rows[7][1].replace(" ", "\t"))]
    assert check(spark, rows, 10, hot) > 0


def test_documents(spark, texts):
    rows = list(enumerate(texts)) + [(900, " ".join(texts[3].split()[5:90])), (901, " ".join(texts[4].split()[:49])), (902, "w" * 9000 + " " + texts[9])]
    assert check(spark, rows, 50, 500) > 0


def test_no_false_equals(spark):
    """Windows whose hashes are equal but whose words differ are told apart."""
    tools = substring.Hashes(), [substring.Rolling(b) for b in substring.BASES]
    tools[0][b"evil"] = tools[0][b"good"] = 7
    b = substring.Bucket([b"a evil b", b"a good b", b"a evil b"], np.array([3, 1, 5]), np.zeros(3, np.int64), 3, *tools)
    assert dict(zip(b.doc.tolist(), b.first.tolist())) == {3: 3, 1: 1, 5: 3}


def test_rows_of_one_id(spark):
    """Rows of one id lose their own words only, whatever texts the others have; equal rows lose alike."""
    a, x, short = " ".join(f"a{i}" for i in range(30)), " ".join(f"x{i}" for i in range(8)), "short text"
    rows = [(1, a), (7, f"{x} {a}"), (7, short), (7, a), (7, a), (9, a + " " + x), (9, short)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = [(1, 30, 0, a), (7, 2, 0, short), (7, 30, 30, ""), (7, 30, 30, ""), (7, 38, 30, x), (9, 2, 0, short), (9, 38, 30, x)]
    for hot in (500, 1):
        got = sorted(tuple(r) for r in substring.without_repeats(docs, 10, hot, keep_text=True).select("doc_id", "n_words", "n_removed", "kept").collect())
        assert got == sorted(want)


def test_hot_windows(spark):
    """A passage that most documents share with other words around it, beside groups of copies."""
    rng = np.random.default_rng(8)
    line = " ".join(f"l{i}" for i in range(25))
    own = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 5000, n))
    copy = f"{own(12)} {line} {own(15)}"
    rows = [(i, copy if i % 4 == 0 else f"{own(int(rng.integers(0, 30)))} {line} {own(int(rng.integers(0, 30)))}") for i in range(120)]
    rows += [(200 + i, line) for i in range(20)] + [(300, " ".join([line] * 40))]
    assert all(check(spark, rows, k, hot) > 0 for k, hot in ((12, 5), (20, 3)))


def test_rough(spark, rough_docs):
    assert substring.without_repeats(rough_docs).count() == 12
    assert substring.trimmed(rough_docs).columns == rough_docs.columns
    assert substring.without_repeats(rough_docs.limit(0)).count() == 0
