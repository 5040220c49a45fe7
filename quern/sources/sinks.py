"""Keyed upserts, reconciliation with a sink, repair of ids, whole graphs and kept vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.graph import Graph


def upsert(have: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``have`` with ``new`` merged in by ``key``: a new row's values that are not null replace the old ones. The latest of several
    new rows of a key is the one with the largest ``ord``."""
    values = [c for c in have.columns if c not in key]
    rows = have.withColumn("_ord", F.lit(-1).cast("long")).unionByName(new.withColumnRenamed("ord", "_ord"), allowMissingColumns=True)
    return rows.groupBy(*key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_ord"))).alias(c) for c in values])


def reconciled(edges: DataFrame, sink_nodes: DataFrame, sink_edges: DataFrame) -> DataFrame:
    """(src, dst, rel_type, state): what a sink lacks of each edge."""
    ids = lambda x: sink_nodes.select(F.col("id").alias(x)).distinct()
    e = sink_edges.select(F.col("src").alias("s"), F.col("dst").alias("d"), F.col("rel_type").alias("r")).distinct()
    at = edges.select("src", "dst", "rel_type").join(ids("a"), F.col("src") == F.col("a"), "left").join(ids("b"), F.col("dst") == F.col("b"), "left")
    at = at.join(e, (F.col("src") == F.col("s")) & (F.col("dst") == F.col("d")) & (F.col("rel_type") == F.col("r")), "left")
    state = F.when(F.col("a").isNull() & F.col("b").isNull(), "both ends missing").when(F.col("a").isNull(), "source missing").when(F.col("b").isNull(), "target missing").when(F.col("r").isNull(), "relation missing").otherwise("present")
    return at.select("src", "dst", "rel_type", state.alias("state"))


def reconciliation(rows: DataFrame) -> DataFrame:
    return rows.groupBy("rel_type", "state").agg(F.count("*").alias("n"))


def repaired(nodes: DataFrame, edges: DataFrame, prefix: str = "Kpop ") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges with a wrong prefix taken off the ids, once each."""
    fix = lambda c: F.regexp_replace(c, f"^(?:{prefix})+", "")
    return nodes.withColumn("id", fix(F.col("id"))).dropDuplicates(["id"]), edges.withColumn("src", fix(F.col("src"))).withColumn("dst", fix(F.col("dst"))).dropDuplicates(["src", "dst", "rel_type"])


def write_graph(graph: Graph, folder: str) -> None:
    """Nodes and edges as two Parquet tables of a folder."""
    graph.nodes.write.mode("overwrite").parquet(f"{folder}/nodes")
    graph.edges.write.mode("overwrite").parquet(f"{folder}/edges")


def read_graph(spark: SparkSession, folder: str) -> Graph:
    """The whole graph that ``write_graph`` put there."""
    return Graph(spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges"))


def cached_vectors(rows: DataFrame, embed: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """(id, text, vector) of ``rows`` (id, text): vectors kept in ``folder`` are taken where the text is still the same, the others are made
    by ``embed`` and kept too."""
    spark = rows.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        embed(rows.select("id", "text")).select("id", "text", "vector").write.parquet(folder)
        return spark.read.parquet(folder)
    have = spark.read.parquet(folder)
    new = rows.select("id", "text").join(have.select("id", "text"), ["id", "text"], "left_anti")
    if not new.isEmpty():
        embed(new).select("id", "text", "vector").write.mode("append").parquet(folder)
    return spark.read.parquet(folder).join(rows.select("id", "text"), ["id", "text"], "left_semi")
