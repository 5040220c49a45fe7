"""Question sets made from a graph, and scores of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(*cols: Column) -> Column:
    """A fixed pseudo-random order: the hexadecimal hash of the columns."""
    return F.md5(F.concat_ws("|", *cols))


def true_false(edges: DataFrame, n: int) -> DataFrame:
    """(src, dst, rel_type, answer): ``n`` edges that hold and as many that do not, by swapping in another edge's target of the same type."""
    e = edges.select("src", "dst", "rel_type").distinct()
    yes = e.orderBy(draw(F.col("src"), F.col("rel_type"), F.col("dst"))).limit(n)
    at = yes.withColumn("k", F.row_number().over(Window.partitionBy("rel_type").orderBy("src", "dst")))
    last = at.groupBy(F.col("rel_type").alias("rt")).agg(F.count("*").alias("many"))
    other = at.select(F.col("rel_type").alias("t"), F.col("k").alias("j"), F.col("dst").alias("wrong"))
    no = at.join(last, F.col("rel_type") == F.col("rt")).join(other, (F.col("rel_type") == F.col("t")) & (F.col("j") == F.col("k") % F.col("many") + 1))
    no = no.select("src", F.col("wrong").alias("dst"), "rel_type").join(e, ["src", "dst", "rel_type"], "left_anti").distinct()
    return yes.withColumn("answer", F.lit(True)).unionByName(no.withColumn("answer", F.lit(False)))


def two_hop_questions(paths: DataFrame, quotas: dict[str, int]) -> DataFrame:
    """(kind, n, start, rel1, rel2, end): scored two-hop paths, one for each (start, rel1, rel2, end), best first, dealt to kinds by quota."""
    once = paths.groupBy("start", "rel1", "rel2", "end").agg(F.max("score").alias("score"))
    total = sum(quotas.values())
    top = once.orderBy(F.desc("score"), draw(F.col("start"), F.col("end")), "start", "end", "rel1", "rel2").limit(total)
    n = F.row_number().over(Window.orderBy(F.desc("score"), draw(F.col("start"), F.col("end")), "start", "end", "rel1", "rel2"))
    kind, edge = F.lit(None).cast("string"), 0
    for name, q in quotas.items():
        kind = F.when(kind.isNull() & (F.col("n") <= edge + q), name).otherwise(kind)
        edge += q
    return top.withColumn("n", n).withColumn("kind", kind).select("kind", "n", "start", "rel1", "rel2", "end")


def distractors(questions: DataFrame, truth: DataFrame, pool: DataFrame, n: int = 3, first: int = 64) -> DataFrame:
    """(start, wrong, place): ``n`` nodes of the pool (id) that are no true answer (start, end) of the question, in drawn order.

    A question meets the ``first`` best drawn ids; one with so many true answers that those might not do meets as many more as
    the largest number of true answers, so that ``n`` are left wherever the pool has them.
    """
    drawn = pool.orderBy(draw(F.col("id")))
    known = truth.select("start", F.col("end").alias("wrong")).distinct()
    sized = questions.select("start").distinct().join(known.groupBy(F.col("start").alias("s")).agg(F.count("*").alias("many")), F.col("start") == F.col("s"), "left")
    at = sized.filter(F.coalesce("many", F.lit(0)) <= first - n).select("start").join(F.broadcast(drawn.limit(first).select(F.col("id").alias("wrong"))))
    large = sized.filter(F.col("many") > first - n).select("start")
    most = sized.agg(F.max("many")).first()[0] or 0
    if most > first - n:
        at = at.unionByName(large.join(drawn.limit(most + n).select(F.col("id").alias("wrong"))))
    at = at.join(known, ["start", "wrong"], "left_anti")
    w = Window.partitionBy("start").orderBy(draw(F.col("start"), F.col("wrong")))
    return at.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def accuracy(results: DataFrame) -> DataFrame:
    """(hops, type, n, accuracy, mean_seconds) over results (hops, type, answer, predicted, seconds): all cuts in one pass, null where not cut."""
    return results.withColumn("right", (F.col("answer") == F.col("predicted")).cast("int")).groupingSets([["hops"], ["type"], []], "hops", "type").agg(F.count("*").alias("n"), F.avg("right").alias("accuracy"), F.avg("seconds").alias("mean_seconds"))


def random_answers(questions: DataFrame, choices: Column, key: Column) -> DataFrame:
    """Questions with a choice drawn by hash."""
    k = F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") % F.size(choices)
    return questions.withColumn("predicted", F.get(choices, k.cast("int")))


def best_system(scores: DataFrame) -> DataFrame:
    """(system, accuracy, best): each system's accuracy and whether it is the best, the first name among equals."""
    per = scores.groupBy("system").agg(F.avg(F.col("right").cast("int")).alias("accuracy"))
    top = per.agg(F.min_by("system", F.struct(-F.col("accuracy"), F.col("system"))).alias("top"))
    return per.crossJoin(F.broadcast(top)).select("system", "accuracy", (F.col("system") == F.col("top")).alias("best"))
