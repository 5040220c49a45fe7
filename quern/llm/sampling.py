"""Which documents are held out, and bounded samples of the others to fit classifiers on.

A classifier is fitted on the driver, on a sample whose number of rows is a parameter; which rows it
has depends on the ids' hashes alone. Everything else an operator does covers every row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def held_out(doc_id: Column, of: int, rest: int = 2) -> Column:
    """Whether crc32 of the id as text leaves ``rest``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % of == rest


#: Values of the column sampled by, at most: the most frequent ones.
VALUES = 64


def by_value(rows: DataFrame, column: str, most: int, key: list[str], values: int = VALUES) -> DataFrame:
    """At most ``most`` rows of each of the ``values`` most frequent values of ``column``, those with the smallest hashes of ``key``.

    The values are counted first and each gets the share of the hash range that holds a little over ``most`` rows,
    so no group of equal values has to meet in one task; rows with equal hashes count as one.
    """
    hashed = F.pmod(F.xxhash64(*key), F.lit(1 << 30))
    counts = rows.groupBy(column).count().orderBy(F.desc("count"), column).limit(values).collect()
    if not counts:
        return rows.limit(0)
    share = F.lit(0)
    for r in sorted(counts, key=lambda r: str(r[column])):
        share = F.when(F.col(column) == r[column], int(min(1.0, (1.2 * most + 30) / r["count"]) * (1 << 30))).otherwise(share)
    some = rows.withColumn("_hash", hashed).filter(F.col("_hash") < share).dropDuplicates([column, "_hash"])
    first = Window.partitionBy(column).orderBy("_hash")
    return some.withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") <= most).drop("_hash", "_rank")
