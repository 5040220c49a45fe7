"""Connected components of a link table, by alternating large and small stars.

Each round moves every link onto the smallest neighbour of its ends, first for larger neighbours, then
for smaller ones, until all links are stars around their component's smallest node. Partitions are
first reduced to spanning forests of their own links. Rounds are tables in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.shared import stored


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node of each node's component, for links a-b over nodes 0 to n - 1."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        for ends in (a, b):
            np.minimum.at(label, label[ends], low)
        while ((jump := label[label]) != label).any():
            label = jump
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, its component's smallest node) that connect what the links a-b connect."""
    if not len(a):
        return a, b
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = roots(at[: len(a)], at[len(a) :], len(nodes))
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a = b = np.zeros(0, np.int64)
    for batch in batches:
        a, b = np.concatenate([a, batch.column(0).to_numpy()]), np.concatenate([b, batch.column(1).to_numpy()])
        if len(a) > 1 << 20:
            x, y = forest(a, b)
            if len(x) > 1 << 19:  # little to gain: hand on
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["u", "v"])
                x = y = np.zeros(0, np.int64)
            a, b = x, y
    a, b = forest(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["u", "v"])


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node in ``links`` (two long columns); roots stand for themselves too."""
    a, b = links.columns
    given = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).filter("u <> v")
    stars = stored(given.mapInArrow(_contract, "u long, v long"), "links")
    seen = None
    for _ in range(most_rounds):
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.join(low, F.col("u") == F.col("w")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.withColumnRenamed("u", "w"), F.col("u") == F.col("w")).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = stored(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "stars")
        now = stars.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components have not settled in {most_rounds} rounds")
    leaves = stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
