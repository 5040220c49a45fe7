"""The property graph: nodes, edges and views of them.

A graph is two DataFrames, ``nodes(id, label, title)`` and ``edges(src, dst, rel_type)`` with one row for
each (src, dst, rel_type), so an edge of several types keeps them all. Other columns ride along.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.iterate import settled

#: Prefixes that derived nodes' ids carry.
PREFIXES = ("Genre", "Company", "Album", "Song", "Artist", "Group", "Occupation", "Instrument", "Customer", "Supplier", "Nation", "Region", "Order", "Part", "Brand", "Type")
#: Spellings of relation types by different producers, and the one kept.
CANONICAL = {"PRODUCED_SONG": "PRODUCE_SONG", "PRODUCED_ALBUM": "PRODUCE_ALBUM", "SUB_UNIT_OF": "SUBUNIT_OF", "COLLABORATED_WITH": "COLLABORATES_WITH", "FEATURED": "COLLABORATES_WITH", "FEATURES": "COLLABORATES_WITH"}


def clean_id(c: Column) -> Column:
    """An id without its kind's prefix."""
    return F.regexp_replace(c, f"^({'|'.join(PREFIXES)})_", "")


def canonical(rel_type: Column) -> Column:
    """One spelling for each relation type."""
    pairs = [F.lit(x) for kv in CANONICAL.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), rel_type), rel_type)


def typed_id(kind: str, key: Column) -> Column:
    return F.concat(F.lit(kind + "_"), key.cast("string"))


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame

    def of_type(self, *rel_types: str) -> DataFrame:
        return self.edges.filter(F.col("rel_type").isin(*rel_types))

    def both_ways(self) -> DataFrame:
        """(id, nbr, rel_type, direction): every edge seen from either end."""
        out = self.edges.select(F.col("src").alias("id"), F.col("dst").alias("nbr"), "rel_type", F.lit("out").alias("direction"))
        back = self.edges.select(F.col("dst").alias("id"), F.col("src").alias("nbr"), "rel_type", F.lit("in").alias("direction"))
        return out.unionByName(back)

    def undirected(self) -> DataFrame:
        """(a, b) with a < b: the simple graph; parallel and opposite edges are one, loops and dangling ends go."""
        ids = self.nodes.select(F.col("id"))
        pairs = self.edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).filter("a <> b").distinct()
        return pairs.join(ids, F.col("a") == F.col("id"), "left_semi").join(ids, F.col("b") == F.col("id"), "left_semi")

    def typed(self, labels: list[str] | None = None, rel_types: list[str] | None = None, undirected: bool = False) -> Graph:
        """A projection by labels and relation types; undirected ones have every edge both ways."""
        nodes = self.nodes.filter(F.col("label").isin(*labels)) if labels else self.nodes
        edges = self.of_type(*rel_types) if rel_types else self.edges
        if labels:
            ids = nodes.select("id")
            edges = edges.join(ids, edges["src"] == ids["id"], "left_semi").join(ids, edges["dst"] == ids["id"], "left_semi")
        if undirected:
            edges = edges.select("src", "dst", "rel_type").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "rel_type")).distinct()
        return Graph(nodes, edges)


def trade(spark: SparkSession, sf_dir: str) -> Graph:
    """The star schema as a graph: customers and suppliers in nations, orders of parts, brands and types."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    customer, supplier, nation, region, orders, part, item = (t(x) for x in ("customer", "supplier", "nation", "region", "orders", "part", "lineitem"))
    node = lambda df, kind, key, title: df.select(typed_id(kind, F.col(key)).alias("id"), F.lit(kind).alias("label"), F.col(title).cast("string").alias("title"))
    nodes = [
        node(customer, "Customer", "c_custkey", "c_name"),
        node(supplier, "Supplier", "s_suppkey", "s_name"),
        node(nation, "Nation", "n_nationkey", "n_name"),
        node(region, "Region", "r_regionkey", "r_name"),
        node(orders, "Order", "o_orderkey", "o_orderpriority"),
        node(part, "Part", "p_partkey", "p_name"),
        node(part.select("p_brand").distinct(), "Brand", "p_brand", "p_brand"),
        node(part.select("p_type").distinct(), "Type", "p_type", "p_type"),
    ]
    edge = lambda df, a, x, rel, b, y: df.select(typed_id(a, F.col(x)).alias("src"), typed_id(b, F.col(y)).alias("dst"), F.lit(rel).alias("rel_type"))
    edges = [
        edge(customer, "Customer", "c_custkey", "MEMBER_OF", "Nation", "c_nationkey"),
        edge(supplier, "Supplier", "s_suppkey", "MEMBER_OF", "Nation", "s_nationkey"),
        edge(nation, "Nation", "n_nationkey", "MANAGED_BY", "Region", "n_regionkey"),
        edge(orders, "Customer", "o_custkey", "PLACED", "Order", "o_orderkey"),
        edge(item.select("l_orderkey", "l_partkey").distinct(), "Order", "l_orderkey", "CONTAINS", "Part", "l_partkey"),
        edge(item.select("l_suppkey", "l_partkey").distinct(), "Supplier", "l_suppkey", "SUPPLIES", "Part", "l_partkey"),
        edge(part, "Part", "p_partkey", "IS_GENRE", "Brand", "p_brand"),
        edge(part, "Part", "p_partkey", "IS_GENRE", "Type", "p_type"),
    ]
    union = lambda dfs: dfs[0] if len(dfs) == 1 else union([dfs[0].unionByName(dfs[1]), *dfs[2:]])
    return Graph(union(nodes), union(edges))


#: The same graph as DuckDB common table expressions.
TRADE_SQL = """
nodes AS (
  SELECT 'Customer_' || c_custkey AS id, 'Customer' AS label, c_name AS title FROM customer
  UNION ALL SELECT 'Supplier_' || s_suppkey, 'Supplier', s_name FROM supplier
  UNION ALL SELECT 'Nation_' || n_nationkey, 'Nation', n_name FROM nation
  UNION ALL SELECT 'Region_' || r_regionkey, 'Region', r_name FROM region
  UNION ALL SELECT 'Order_' || o_orderkey, 'Order', o_orderpriority FROM orders
  UNION ALL SELECT 'Part_' || p_partkey, 'Part', p_name FROM part
  UNION ALL SELECT DISTINCT 'Brand_' || p_brand, 'Brand', p_brand FROM part
  UNION ALL SELECT DISTINCT 'Type_' || p_type, 'Type', p_type FROM part),
edges AS (
  SELECT 'Customer_' || c_custkey AS src, 'Nation_' || c_nationkey AS dst, 'MEMBER_OF' AS rel_type FROM customer
  UNION ALL SELECT 'Supplier_' || s_suppkey, 'Nation_' || s_nationkey, 'MEMBER_OF' FROM supplier
  UNION ALL SELECT 'Nation_' || n_nationkey, 'Region_' || n_regionkey, 'MANAGED_BY' FROM nation
  UNION ALL SELECT 'Customer_' || o_custkey, 'Order_' || o_orderkey, 'PLACED' FROM orders
  UNION ALL SELECT DISTINCT 'Order_' || l_orderkey, 'Part_' || l_partkey, 'CONTAINS' FROM lineitem
  UNION ALL SELECT DISTINCT 'Supplier_' || l_suppkey, 'Part_' || l_partkey, 'SUPPLIES' FROM lineitem
  UNION ALL SELECT 'Part_' || p_partkey, 'Brand_' || p_brand, 'IS_GENRE' FROM part
  UNION ALL SELECT 'Part_' || p_partkey, 'Type_' || p_type, 'IS_GENRE' FROM part),
both_ways AS (
  SELECT src AS id, dst AS nbr, rel_type, 'out' AS direction FROM edges
  UNION ALL SELECT dst, src, rel_type, 'in' FROM edges)
"""


def similarity(spark: SparkSession, sf_dir: str, least: float = 0.3, block: int = 4096) -> Graph:
    """Vectors as nodes, linked where their cosine exceeds ``least``; computed in blocks of about ``block`` with matrix products.

    Vectors are dealt to blocks by id; a block meets every block once, as two packed rows.
    """
    import numpy as np
    import pandas as pd

    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    n = v.count()
    blocks = max(1, -(-n // block))
    # keys of both sides must be of one type: an int and a long of equal value hash to different partitions
    dealt = v.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    left = dealt.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"), "block", "vec_id", "embedding").filter("other >= block")

    def near(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"src": [], "dst": []}, dtype="int64")
        unit = lambda x: (m := np.array(x.tolist(), np.float64)) / np.sqrt((m * m).sum(1, keepdims=True))
        i, j = np.nonzero(unit(a["embedding"]) @ unit(b["embedding"]).T > least)
        x, y = a["vec_id"].to_numpy()[i], b["vec_id"].to_numpy()[j]
        keep = x != y
        return pd.DataFrame({"src": np.minimum(x, y)[keep], "dst": np.maximum(x, y)[keep]}).drop_duplicates()

    pairs = left.withColumn("mine", F.col("block"))
    right = dealt.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("mine"), F.col("block").alias("other"), "vec_id", "embedding").filter("other >= mine")
    found = pairs.groupBy("mine", "other").cogroup(right.groupBy("mine", "other")).applyInPandas(near, "src long, dst long").distinct()
    nodes = v.select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("label"), F.col("vec_id").cast("string").alias("title"))
    return Graph(nodes, settled(found).withColumn("rel_type", F.lit("NEAR")))


SIMILARITY_SQL = """
vec AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
unit AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM vec),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM unit a JOIN unit b ON a.vec_id < b.vec_id AND list_dot_product(a.e, b.e) / (a.norm * b.norm) > 0.3),
verts AS (SELECT vec_id AS id, CAST(label AS VARCHAR) AS label FROM vec),
adj AS (SELECT a AS id, b AS nbr FROM pairs UNION ALL SELECT b, a FROM pairs)
"""


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, weight): nations by the number of line items between customers and suppliers of two."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    c = t("customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("src"))
    s = t("supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("dst"))
    item = t("lineitem").select("l_orderkey", "l_suppkey").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return item.join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("src", "dst").agg(F.count("*").alias("weight"))


ROUTES_SQL = """
routes AS (
  SELECT CAST(c_nationkey AS BIGINT) AS src, CAST(s_nationkey AS BIGINT) AS dst, count(*) AS weight
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  GROUP BY 1, 2)
"""
