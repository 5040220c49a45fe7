"""Mentions and relationships from text, by tables of patterns, dictionaries and rules."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import names as N


def by_patterns(docs: DataFrame, patterns: list[tuple[str, str]], confidence: float = 0.7) -> DataFrame:
    """(doc_id, type, text, confidence): first groups of all matches of each (type, pattern), once a document. One pass over the texts."""
    typed = lambda kind: lambda m: F.struct(F.lit(kind).alias("type"), m.alias("text"))
    found = [F.transform(F.regexp_extract_all("text", F.lit(p), 1), typed(kind)) for kind, p in patterns]
    rows = docs.select("doc_id", F.explode(F.array_distinct(F.concat(*found))).alias("m"))
    return rows.select("doc_id", "m.type", "m.text", F.lit(confidence).alias("confidence"))


def from_lists(docs: DataFrame, pattern: str, kind: str, confidence: float = 0.8) -> DataFrame:
    """(doc_id, type, text, confidence): items of the lists that ``pattern``'s first group matches."""
    lists = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(pattern), 1)).alias("list"))
    return lists.select("doc_id", F.lit(kind).alias("type"), F.explode(N.split_list(F.col("list"))).alias("text"), F.lit(confidence).alias("confidence")).distinct()


def tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, place, start, word): space-separated words with their first character's position from 1."""
    at = docs.select("doc_id", F.posexplode(F.split("text", " ")).alias("place", "word"))
    before = Window.partitionBy("doc_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    at = at.withColumn("start", (1 + F.coalesce(F.sum(F.length("word") + 1).over(before), F.lit(0))).cast("int"))
    return at.select("doc_id", "place", "start", "word").filter("word <> ''")


def by_dictionary(docs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(doc_id, start, end, name, type): dictionary names that stand in the text as whole words, longer ones first, none overlapping.

    Runs of as many words as the dictionary's longest name are looked up by an equi-join, whatever the dictionary's size; what
    overlaps within a document is settled by one pass over its few mentions.
    """
    longest = dictionary.agg(F.max(F.size(F.split("name", " ")))).first()[0] or 1
    words = docs.select("doc_id", F.filter(F.split(F.regexp_replace("text", "[.,;:!?]", " "), " "), lambda w: w != "").alias("w"))
    spots = words.select("doc_id", F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1))), lambda i: F.struct((i - 1).alias("start"), (i + n - 1).alias("end"), F.array_join(F.slice("w", i, n), " ").alias("name")))))).alias("s")).select("doc_id", "s.*")
    hits = spots.join(dictionary.select(F.col("name"), "type"), "name")
    rows = hits.groupBy("doc_id").agg(F.collect_list(F.struct((F.col("start") - F.col("end")).alias("shorter"), "start", "end", "name", "type")).alias("all"))
    kept = F.aggregate(F.array_sort("all"), F.slice("all", 1, 0), lambda a, x: F.when(F.exists(a, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])), a).otherwise(F.concat(a, F.array(x))))
    return rows.select("doc_id", F.explode(kept).alias("m")).select("doc_id", "m.start", "m.end", "m.name", "m.type")


def valid(mentions: DataFrame, rules: list[tuple[str, str]], stop: list[str]) -> DataFrame:
    """Mentions of 2 to 50 characters that no reject rule (name, pattern) matches and that are no stop word; no rule's cost grows with their number."""
    reject = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), F.lit(n)) for n, p in rules]))
    return mentions.filter(F.length("text").between(2, 50)).withColumn("rules", reject).filter(F.size("rules") == 0).drop("rules").filter(~F.lower("text").isin(*stop))


def context(mentions: DataFrame, docs: DataFrame, around: int = 100) -> DataFrame:
    """Mentions with the characters around their first occurrence."""
    at = mentions.join(docs.select("doc_id", F.col("text").alias("body")), "doc_id").withColumn("at", F.expr("locate(text, body)"))
    return at.filter("at > 0").withColumn("context", F.expr(f"substring(body, greatest(at - {around}, 1), at - greatest(at - {around}, 1) + length(text) + {around})")).drop("body")


def keyword_score(text: Column, weights: dict[str, int]) -> Column:
    """Sum of the weights of the keywords that a text contains."""
    total = F.lit(0)
    for word, x in weights.items():
        total = total + F.when(F.contains(F.lower(text), F.lit(word)), x).otherwise(0)
    return total


def merged(mentions: DataFrame) -> DataFrame:
    """(key, type, text, sources, confidence) for mentions (doc_id, type, text, confidence, rank): by comparison key and type; the text of the best rank."""
    at = mentions.withColumn("key", N.compare_key(F.col("text")))
    return at.groupBy("key", "type").agg(F.min_by("text", F.struct("rank", "text")).alias("text"), F.array_sort(F.collect_set("doc_id")).alias("sources"), F.max("confidence").alias("confidence"))


def boosted(entities: DataFrame, known: list[str]) -> DataFrame:
    """Confidence raised for 2, 3 and 5 sources (+.1, .15, .2, up to .85, .9, .95) and for known names (+.1, up to 1)."""
    n, c = F.size("sources"), F.col("confidence")
    up = F.when(n >= 5, F.least(c + 0.2, F.lit(0.95))).when(n >= 3, F.least(c + 0.15, F.lit(0.9))).when(n >= 2, F.least(c + 0.1, F.lit(0.85))).otherwise(c)
    up = F.greatest(c, up)
    return entities.withColumn("confidence", F.round(F.when(F.col("key").isin(*known), F.least(up + 0.1, F.lit(1.0))).otherwise(up), 6))


def retyped(entities: DataFrame, surnames: list[str], wrong: str = "Group", right: str = "Artist") -> DataFrame:
    """Names of two or three words that begin with a surname are persons, not groups."""
    words = F.split("text", " ")
    person = (F.col("type") == wrong) & F.size(words).between(2, 3) & F.lower(words[0]).isin(*surnames)
    return entities.withColumn("type", F.when(person, right).otherwise(F.col("type")))


def ranked(entities: DataFrame) -> DataFrame:
    return entities.orderBy(F.desc("confidence"), "type", "text")


def judged(rows: DataFrame, judge: Callable[[pd.DataFrame], pd.Series], least: float = 0.7, step: float = 0.1) -> DataFrame:
    """Rows of at least ``least`` confidence after a judge's verdict for each: VALID raises it, UNCERTAIN keeps it, INVALID drops the row.

    ``judge`` takes batches of rows and may hold any model; verdicts are compared whole.
    """
    schema = rows.schema.add("verdict", "string")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(verdict=judge(frame).str.strip().str.upper())

    at = rows.filter(F.col("confidence") >= least).mapInPandas(run, schema)
    return at.filter("verdict <> 'INVALID'").withColumn("confidence", F.when(F.col("verdict") == "VALID", F.least(F.col("confidence") + step, F.lit(0.99))).otherwise(F.col("confidence"))).drop("verdict")


def chunks(docs: DataFrame, size: int = 2000, overlap: int = 200) -> DataFrame:
    """(doc_id, chunk, part): texts in overlapping parts."""
    starts = F.sequence(F.lit(0), F.greatest(F.length("text") - overlap - 1, F.lit(0)), F.lit(size - overlap))
    return docs.select("doc_id", "text", F.posexplode(starts).alias("chunk", "at")).select("doc_id", "chunk", F.expr(f"substring(text, at + 1, {size})").alias("part"))


def near_pairs(spans: DataFrame, most: int = 150) -> DataFrame:
    """(doc_id, first, second, gap): spans (doc_id, start, end, name) that follow each other within ``most`` characters; the closest of each pair of names."""
    a, b = (spans.select(F.col("doc_id").alias("doc_id" if x == "a" else "d"), *[F.col(c).alias(f"{x}_{c}") for c in ("start", "end", "name")]) for x in "ab")
    gap = F.col("b_start") - F.col("a_end")
    on = (F.col("doc_id") == F.col("d")) & gap.between(0, most) & (F.col("a_name") != F.col("b_name"))
    return a.join(b, on).groupBy("doc_id", F.least("a_name", "b_name").alias("first"), F.greatest("a_name", "b_name").alias("second")).agg(F.min(gap).alias("gap"))


def confidence(pattern: Column, keywords: Column, length: Column) -> Column:
    """.7, +.15 for a pattern (else -.1), +.05 a keyword up to .1, -.15 beyond 200 characters or -.2 beyond 300; 0 to .95."""
    c = 0.7 + F.when(pattern, 0.15).otherwise(-0.1) + F.least(keywords * 0.05, F.lit(0.1)) - F.when(length > 300, 0.2).when(length > 200, 0.15).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(c, F.lit(0.95)))


def cooccurrence(mentions: DataFrame) -> DataFrame:
    """(a, b, n): names by the number of sources (doc_id) that have both."""
    once = mentions.select("doc_id", "name").distinct()
    other = once.select(F.col("doc_id").alias("d"), F.col("name").alias("b"))
    return once.join(other, (F.col("doc_id") == F.col("d")) & (F.col("name") < F.col("b"))).groupBy(F.col("name").alias("a"), "b").agg(F.count("*").alias("n"))


def boost(relations: DataFrame, together: DataFrame) -> DataFrame:
    """Relations (src, dst, confidence) raised by .03 for each common source, .15 at most, up to .98."""
    at = relations.join(together, (F.least("src", "dst") == F.col("a")) & (F.greatest("src", "dst") == F.col("b")), "left")
    return at.withColumn("confidence", F.round(F.least(F.col("confidence") + F.least(0.03 * F.coalesce("n", F.lit(0)), F.lit(0.15)), F.lit(0.98)), 6)).drop("a", "b", "n")


def unseen(relations: DataFrame, edges: DataFrame) -> DataFrame:
    """Relations that the graph has not, once each, by comparison keys of their ends and type."""
    keyed = lambda df: df.withColumn("_a", N.compare_key(F.col("src"))).withColumn("_b", N.compare_key(F.col("dst")))
    return keyed(relations).dropDuplicates(["_a", "_b", "rel_type"]).join(keyed(edges).select("_a", "_b", "rel_type"), ["_a", "_b", "rel_type"], "left_anti").drop("_a", "_b")


def degree_report(edges: DataFrame, top: int = 20) -> DataFrame:
    """(id, degree): the ends of most edges."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "id").limit(top)


def closest(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in the given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_n = 1").drop("_n")


def by_gazetteer(docs: DataFrame, names: list[str], kind: str, confidence: float = 0.95) -> DataFrame:
    """(doc_id, type, text, confidence): known names that a text contains."""
    hit = F.array_compact(F.array(*[F.when(F.contains(F.lower("text"), F.lit(n.lower())), F.lit(n)) for n in names]))
    return docs.select("doc_id", F.lit(kind).alias("type"), F.explode(hit).alias("text"), F.lit(confidence).alias("confidence"))


def from_fields(rows: DataFrame, fields: dict[str, tuple[str, float]]) -> DataFrame:
    """(src, dst, rel_type, confidence): items of list-valued fields, each field with its relation and confidence."""
    out = None
    for field, (rel, sure) in fields.items():
        part = rows.select(F.col("id").alias("src"), F.explode(N.split_list(F.col(field))).alias("dst"), F.lit(rel).alias("rel_type"), F.lit(sure).alias("confidence"))
        out = part if out is None else out.unionByName(part)
    return out


def classified(pairs: DataFrame, matrix: list[tuple[str, str, str, str]]) -> DataFrame:
    """(doc_id, src, dst, rel_type): pairs (doc_id, a, a_type, b, b_type, between) in either direction by rules
    (type, type, relation, keyword that stands between), the first relation in order."""
    rules = pairs.sparkSession.createDataFrame([(*m, i) for i, m in enumerate(matrix)], "t1 string, t2 string, rel_type string, keyword string, place int")
    back = pairs.select("doc_id", F.col("b").alias("a"), F.col("b_type").alias("a_type"), F.col("a").alias("b"), F.col("a_type").alias("b_type"), "between")
    at = pairs.select(*back.columns).unionByName(back).join(F.broadcast(rules), (F.col("a_type") == F.col("t1")) & (F.col("b_type") == F.col("t2")) & F.contains(F.lower("between"), F.col("keyword")))
    return at.groupBy("doc_id", F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.min_by("rel_type", "place").alias("rel_type"))


def plausible(relations: DataFrame, generic: list[str], least: float = 0.7) -> DataFrame:
    """Relations (src, dst, rel_type, confidence, distance) that are sure and close enough, between names of 2 to 100 characters that say something."""
    named = lambda c: F.length(c).between(2, 100) & ~F.lower(c).isin(*generic)
    far = F.when(F.col("rel_type") == "MEMBER_OF", 100).otherwise(150)
    return relations.filter(named(F.col("src")) & named(F.col("dst")) & (F.col("src") != F.col("dst")) & (F.col("confidence") >= least) & (F.col("distance") <= far))
