"""Mixing sources to target weights.

Every document gets a hash-random key; rows equal in id, source and text are one group with its number of copies. Within each source the documents are ranged by that key
(a power-of-two number of key ranges, so each range holds about the same number of rows whatever
the source's size), the word counts of the ranges are summed, prefix sums over the ranges give each
range its offset, and a running sum inside one range places every document on its source's line of
words. The source's budget cuts that line exactly; a budget beyond the source's size repeats whole
epochs first. A source that holds a third of all rows is spread over as many ranges as its rows fill.

Defined results: null text counts 0 words and takes none; null source is a source of its own, last
in order; rows of equal id keep one row each, in the order of their sizes and texts; rows equal in id, source and text share their
words out among themselves, so reruns give the same rows; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.shared import stored

WORD = r"[^\x20\x09-\x0D]+"
#: Rows in one key range, about, and the most ranges (as a power of two), which bounds the table of offsets.
RANGE_ROWS, MOST_BITS = 2_000, 16


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float], share: float, most: float) -> list[float]:
    """Words for each source: ``share`` of all sizes by weight, none above ``most`` times its size.

    What a stopped source leaves is shared again by weight among the others until none is above.
    """
    out, left, open_ = [0.0] * len(sizes), share * sum(sizes), list(range(len(sizes)))
    while open_:
        total = sum(weights[i] for i in open_)
        above = {i for i in open_ if left * weights[i] / total > most * sizes[i]}
        if not above:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in sorted(above):
            out[i] = float(most * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in above]
    return out


def _placed(docs: DataFrame, tie: Column, weights: Sequence[float], share: float, most: float, range_rows: int) -> DataFrame:
    """One row for each group of rows equal in doc_id, source, text and ``tie``, with its source's plan.

    Columns: doc_id, source, size, key, tie, copies, source_size, target, epochs (whole ones, of every row), rest (the words
    of the source's line that are taken beside them), at (where the first copy begins on the line).
    """
    spark = docs.sparkSession
    key = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), key.alias("key"), F.xxhash64("text").alias("mark"), tie.alias("tie"))
    sized = stored(sized.groupBy(*sized.columns).agg(F.count("*").alias("copies")), "mix-sizes")
    totals = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.sum("copies").alias("n")).collect()
    totals.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    budget = targets([r["source_size"] for r in totals], [weights[i % len(weights)] for i in range(len(totals))], share, most)
    rows = sum(r["n"] for r in totals)
    bits = min(MOST_BITS, (rows // range_rows).bit_length())
    plan = spark.createDataFrame(
        [(r["source"], r["source_size"], t) for r, t in zip(totals, budget)],
        "p_source string, source_size long, target double",
    )
    words = F.col("size") * F.col("copies")
    ranged = sized.withColumn("range", F.shiftright("key", 60 - bits)).withColumn("sub", F.lit(0).cast("long"))
    # rows of one id (or none) with many texts fill one range: such ranges are parted by the texts' hashes
    full = ranged.groupBy(F.col("source").alias("f_source"), F.col("range").alias("f_range")).agg(F.count("*").alias("full")).filter(F.col("full") > 16 * range_rows)
    parted = full.count()
    if parted:
        ranged = ranged.join(F.broadcast(full) if parted <= 100_000 else full, F.col("source").eqNullSafe(F.col("f_source")) & (F.col("range") == F.col("f_range")), "left")
        ranged = ranged.withColumn("sub", F.coalesce(F.pmod("mark", F.ceil(F.col("full") / range_rows)), "sub")).drop("f_source", "f_range", "full")
    before = Window.partitionBy("source").orderBy("range", "sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("source", "range", "sub").agg(F.sum(words).alias("words")).select(
        F.col("source").alias("o_source"), F.col("range").alias("o_range"), F.col("sub").alias("o_sub"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset")
    )
    within = Window.partitionBy("source", "range", "sub").orderBy("key", "doc_id", "size", "mark", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("here", F.coalesce(F.sum(words).over(within), F.lit(0)))
    placed = placed.join(F.broadcast(offsets) if not parted and len(totals) << bits <= 100_000 else offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("range") == F.col("o_range")) & (F.col("sub") == F.col("o_sub")))
    placed = placed.join(F.broadcast(plan) if len(totals) <= 100_000 else plan, F.col("source").eqNullSafe(F.col("p_source")))
    budgeted, whole = F.floor(F.col("target") + 0.5), F.col("source_size")
    epochs = F.when(whole > 0, F.floor(budgeted / whole)).otherwise(0).cast("long")
    return placed.select("doc_id", "source", "size", "key", "tie", "copies", "source_size", "target", epochs.alias("epochs"), (budgeted - epochs * whole).cast("long").alias("rest"), (F.col("offset") + F.col("here")).alias("at"))


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row of ``docs``.

    ``weights`` go to the sources in code point order, null last, repeating. The per-source totals
    (one row for each source) are the only thing the driver sees.
    """
    placed = _placed(docs, F.lit(0), weights, share, most, range_rows)
    run = 10_000  # copies of one group come in runs, so that no array holds them all
    each = placed.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / run))))
    each = each.withColumn("copy", F.explode(F.sequence(F.col("run") * run, F.least(F.col("copies"), (F.col("run") + 1) * run) - 1)))
    cut = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("rest") - F.col("at") - F.col("copy") * F.col("size")))
    return each.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + cut).cast("long").alias("taken"))


def mixture(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The rows of the mix itself, with the columns of ``docs``.

    A row that is taken k whole times comes k times; the one at its source's cut also comes
    with its first words only, up to the budget. Rows without a word take no part; rows equal in every column
    count as many words as they are, and come as often as their words are taken.
    """
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    placed = _placed(docs.select("doc_id", "source", "text", tie.alias("_mix_tie")), F.col("_mix_tie"), weights, share, most, range_rows)
    here = F.greatest(F.lit(0).cast("long"), F.least(F.col("copies") * F.col("size"), F.col("rest") - F.col("at")))
    placed = placed.select(F.col("doc_id").alias("_mix_id"), F.col("tie").alias("_mix_row"), F.col("size").alias("_mix_size"), F.col("copies").alias("_mix_copies"), (F.col("copies") * F.col("epochs") * F.col("size") + here).alias("_mix_taken"))
    placed = stored(placed.filter("_mix_taken > 0"), "mix-taken")
    same = F.col("doc_id").eqNullSafe(F.col("_mix_id")) & (tie == F.col("_mix_row"))
    rows = docs.join(placed, same)
    if placed.filter("_mix_copies > 1").limit(1).count():  # one row stands for those that are equal
        rows = docs.join(placed.filter("_mix_copies = 1"), same).unionByName(docs.dropDuplicates().join(placed.filter("_mix_copies > 1"), same))
    full = F.floor(F.col("_mix_taken") / F.col("_mix_size")).cast("int")
    rest = F.col("_mix_taken") % F.col("_mix_size")
    lengths = F.concat(F.array_repeat(F.lit(-1).cast("long"), full), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<long>")))
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col("text"), F.lit(WORD), 0), 1, F.col("_mix_keep").cast("int")), " ")
    rows = rows.withColumn("_mix_keep", F.explode(lengths)).withColumn("_mix_text", F.when(F.col("_mix_keep") < 0, F.col("text")).otherwise(cut))
    out = rows.select(*[F.col("_mix_text").alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


#: The same plan in DuckDB. Sources stop in rounds; the water level at which each stops is found from
#: the running sums of the sources sorted by size over weight.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS key
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w
  FROM d GROUP BY source),
r AS (
  SELECT *, CAST(sum(2 * source_size) OVER o AS DOUBLE) AS stopped, sum(w) OVER (ORDER BY source_size / w DESC, source DESC NULLS FIRST) AS open_w,
         coalesce(CAST(sum(2 * source_size) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 0) AS below,
         1.5 * CAST(sum(source_size) OVER () AS DOUBLE) AS total
  FROM s WINDOW o AS (ORDER BY source_size / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
level AS (
  SELECT coalesce(max_by(left_, stopped), 1.5 * (SELECT CAST(sum(source_size) AS DOUBLE) FROM s)) AS left_,
         coalesce(max_by(open_after, stopped), (SELECT sum(w) FROM s)) AS open_w, coalesce(max(n), 0) AS n
  FROM (SELECT total - stopped AS left_, stopped, open_w - w AS open_after, row_number() OVER (ORDER BY source_size / w, source NULLS LAST) AS n,
               (total - below) * w / open_w > 2 * source_size AS above FROM r) WHERE above),
t AS (
  SELECT source, source_size, CASE WHEN row_number() OVER (ORDER BY source_size / w, source NULLS LAST) <= n THEN CAST(2 * source_size AS DOUBLE)
                                   ELSE left_ * w / level.open_w END AS target
  FROM s, level),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS words,
         coalesce(CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS here
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE CAST((words // source_size) * size + greatest(0, least(size, words % source_size - here)) AS BIGINT) END AS taken
FROM p
"""
