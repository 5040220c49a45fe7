"""Graph documents: one JSON object with ``nodes`` by id and a list of ``edges``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.graph import Graph, canonical

NODE = "label string, title string, infobox map<string,string>, url string, depth int, properties map<string,string>"
EDGE = "source string, target string, type string, text string, confidence double, properties map<string,string>"
SCHEMA = f"nodes map<string, struct<{NODE.replace(' string', ':string').replace(' map', ':map').replace(' int', ':int')}>>, edges array<struct<{EDGE.replace(' string', ':string').replace(' map', ':map').replace(' double', ':double')}>>"


def load(spark: SparkSession, path: str) -> Graph:
    """A graph from its JSON document: a row for each (src, dst, type), confidence from the edge, its properties, or 1."""
    doc = spark.read.schema(SCHEMA).json(path, multiLine=True)
    nodes = doc.select(F.explode("nodes").alias("id", "n")).select("id", "n.*").withColumn("title", F.coalesce("title", "id"))
    e = doc.select(F.explode("edges").alias("e")).select("e.*")
    sure = F.coalesce("confidence", F.expr("try_cast(properties['confidence'] AS double)"), F.lit(1.0))
    edges = e.select(F.col("source").alias("src"), F.col("target").alias("dst"), canonical(F.col("type")).alias("rel_type"), "text", sure.alias("confidence"))
    return Graph(nodes, edges.dropDuplicates(["src", "dst", "rel_type"]))


def load_if_there(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON records at ``path``, or none where nothing is there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(schema).json(path) if there else spark.createDataFrame([], schema)


def united(base: Graph, entities: DataFrame, relations: DataFrame) -> Graph:
    """A graph with entities (id, label, title) whose id it has not, and relations (src, dst, rel_type) that it has not."""
    nodes = base.nodes.unionByName(entities.dropDuplicates(["id"]).join(base.nodes.select("id"), "id", "left_anti"), allowMissingColumns=True)
    key = ["src", "dst", "rel_type"]
    edges = base.edges.unionByName(relations.dropDuplicates(key).join(base.edges.select(*key), key, "left_anti"), allowMissingColumns=True)
    return Graph(nodes, edges)


def save(graph: Graph, folder: str) -> None:
    """Nodes and edges as JSON lines below ``folder``, written by all tasks."""
    graph.nodes.write.mode("overwrite").json(f"{folder}/nodes")
    graph.edges.write.mode("overwrite").json(f"{folder}/edges")


def read_back(spark: SparkSession, folder: str) -> Graph:
    return Graph(spark.read.schema("id string, label string, title string").json(f"{folder}/nodes"), spark.read.schema("src string, dst string, rel_type string").json(f"{folder}/edges"))


def triples(graph: Graph) -> DataFrame:
    """(s, p, o): each edge by its first relation type in order."""
    return graph.edges.groupBy(F.col("src").alias("s"), F.col("dst").alias("o")).agg(F.min("rel_type").alias("p")).select("s", "p", "o")
