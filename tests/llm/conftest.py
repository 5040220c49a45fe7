import duckdb
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def texts():
    return [r[0] for r in duckdb.sql(f"select text from '{SF}/documents.parquet' order by doc_id").fetchall()]


@pytest.fixture
def rough_docs(spark, texts):
    """Null and empty values, very long texts, ties, repeated texts, and columns with clashing names."""
    base = texts[3]
    rows = [
        (1, None, "en", "a", None),
        (2, "", None, "a", 0),
        (3, " \n\t ", "en", None, 4),
        (4, base, "en", "a", len(base)),
        (5, base, "en", "a", len(base)),
        (6, base + " tail words", "de", "b", 1),
        (7, "w" * 20000, "fr", "b", 20000),
        (8, " ".join(texts[:40]), "fr", None, 5),
        (9, "one", "es", "b", 3),
        (10, "one", None, None, 3),
        (11, "Ünïcödé 日本語 \x85 x y <|endoftext|> z", "de", "", 9),
        (12, "a  b   c\n\n\nd ", "de", "a", 9),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame(rows, schema)
    for extra in ("n_words", "size", "key", "component_id", "score", "ids", "range", "word", "n_tokens", "start", "_id"):
        df = df.selectExpr("*", f"'x' AS {extra}")
    return df
