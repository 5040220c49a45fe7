"""Merging extracted entities and relations into a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.names import compare_key


def enriched(nodes: DataFrame, entities: DataFrame) -> DataFrame:
    """Nodes (id, label, title) with the confidence and method of the entity (text, type) of the same key and type, the surest one."""
    best = entities.groupBy(compare_key(F.col("text")).alias("k"), "type").agg(F.max("confidence").alias("ner_confidence"), F.max_by("method", F.struct("confidence", "method")).alias("ner_method"))
    return nodes.join(best, (compare_key(F.col("title")) == F.col("k")) & (F.col("label") == F.col("type")), "left").select(*nodes.columns, "ner_confidence", "ner_method")


def claimed(nodes: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, label, original_name): new nodes for entities without one. An id taken by another type, or by an earlier entity in
    (text, type) order, becomes ``id (Type)``; if that is taken too the entity gets none."""
    have = nodes.select(compare_key(F.col("title")).alias("k"), F.col("label").alias("l")).distinct()
    new = entities.select("text", "type").distinct().withColumn("key", compare_key(F.col("text"))).join(have, (F.col("key") == F.col("k")) & (F.col("type") == F.col("l")), "left_anti")
    new = new.withColumn("n", F.row_number().over(Window.partitionBy("text").orderBy("type")))
    taken = nodes.select(F.col("id").alias("t")).distinct()
    new = new.join(taken, F.col("text") == F.col("t"), "left").withColumn("id", F.when(F.col("t").isNull() & (F.col("n") == 1), F.col("text")).otherwise(F.concat("text", F.lit(" ("), "type", F.lit(")")))).drop("t")
    return new.join(taken, F.col("id") == F.col("t"), "left_anti").select("id", F.col("type").alias("label"), F.when(F.col("id") != F.col("text"), F.col("text")).alias("original_name"))


def resolved_ends(mentions: DataFrame, nodes: DataFrame) -> DataFrame:
    """(name, type, id, score): the best node of the type for each name. Equal keys score 100 + length, a common word of three
    letters or more where one contains the other 50 + length of the shorter; ties go to the smaller id."""
    m = mentions.select("name", "type").distinct().withColumn("mk", compare_key(F.col("name")))
    n = nodes.select("id", "label", compare_key(F.col("title")).alias("nk"), F.lower("title").alias("lt"))
    exact = m.join(n, (F.col("mk") == F.col("nk")) & (F.col("type") == F.col("label"))).select("name", "type", "id", (F.length("mk") + 100).alias("score"))
    words = lambda df, c: df.withColumn("word", F.explode(F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 3))))
    near = words(m, "name").join(words(n, "lt").withColumnRenamed("word", "w"), (F.col("word") == F.col("w")) & (F.col("type") == F.col("label")))
    near = near.filter((F.col("mk") != F.col("nk")) & (F.contains("mk", "nk") | F.contains("nk", "mk"))).select("name", "type", "id", (F.least(F.length("mk"), F.length("nk")) + 50).alias("score")).distinct()
    best = F.min_by("id", F.struct(-F.col("score"), F.col("id")))
    return exact.unionByName(near).groupBy("name", "type").agg(best.alias("id"), F.max("score").alias("score"))


def placed(relations: DataFrame, ends: DataFrame) -> DataFrame:
    """Relations (src, src_type, dst, dst_type, rel_type) with their ends' ids, and which end is missing."""
    of = lambda x: ends.select(F.col("name").alias(f"{x}_n"), F.col("type").alias(f"{x}_t"), F.col("id").alias(f"{x}_id"))
    at = relations.join(of("s"), (F.col("src") == F.col("s_n")) & (F.col("src_type") == F.col("s_t")), "left").join(of("d"), (F.col("dst") == F.col("d_n")) & (F.col("dst_type") == F.col("d_t")), "left")
    missing = F.when(F.col("s_id").isNull() & F.col("d_id").isNull(), "both").when(F.col("s_id").isNull(), "source").when(F.col("d_id").isNull(), "target").otherwise("none")
    return at.select(F.col("s_id").alias("src"), F.col("d_id").alias("dst"), "rel_type", "src_type", "dst_type", missing.alias("missing"))


def edge_union(edges: DataFrame, more: DataFrame) -> DataFrame:
    """Both edge tables' (src, dst, rel_type), once each."""
    cols = ["src", "dst", "rel_type"]
    return edges.select(*cols).unionByName(more.select(*cols)).distinct()
