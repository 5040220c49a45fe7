"""Finding entities and contexts for questions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.names import display
from quern.graph import Graph


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, z: s + z)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def _unit(column: pa.ChunkedArray) -> np.ndarray:
    m = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]).astype(np.float64).reshape(len(column), -1)
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def semantic(queries: DataFrame, vectors: DataFrame, k: int = 5, least: float = -1.0, block: int = 8192) -> DataFrame:
    """(query_id, place, id, score): nearest vectors of each query by cosine, in double precision, without itself.

    ``queries`` is a stated set; in blocks of ``block`` rows it meets blocks of the vectors as matrix products, and each pair of
    blocks keeps the k best of each of its queries before they are merged.
    """
    sides = [queries.select(F.col("vec_id").alias("id"), "embedding"), vectors.select(F.col("vec_id").alias("id"), "embedding")]
    many = [max(1, -(-side.count() // block)) for side in sides]
    # block numbers are ints on both sides: an int and a long of equal value hash to different partitions
    dealt = [side.filter("id IS NOT NULL AND embedding IS NOT NULL").withColumn("own", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")) for side, n in zip(sides, many, strict=True)]
    asks = dealt[0].withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(many[1] - 1))))
    rows = dealt[1].withColumn("asking", F.explode(F.sequence(F.lit(0), F.lit(many[0] - 1))))

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if a.num_rows and b.num_rows:
            (qid, q), (vid, v) = ((t.column("id").to_numpy(), _unit(t.column("embedding"))) for t in (a, b))
            s = q @ v.T
            s[qid[:, None] == vid[None, :]] = -np.inf
            cut = np.partition(s, -min(k, len(vid)), axis=1)[:, -min(k, len(vid))]
            i, j = np.nonzero((s >= cut[:, None]) & (s > least) & np.isfinite(s))  # all that tie with the k-th
            out = [qid[i], vid[j], s[i, j]]
        return pa.table([pa.array(x) for x in out], ["query_id", "id", "score"])

    scored = asks.groupBy("own", "other").cogroup(rows.groupBy("asking", F.col("own").alias("other_"))).applyInArrow(best, "query_id long, id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k).select("query_id", "place", "id", "score")


def variants(nodes: DataFrame, longest: int = 4) -> DataFrame:
    """(name, id, label): ways to write each title, with one node for each name: Group before Artist before the rest, then the smaller id."""
    rank = F.when(F.col("label") == "Group", 0).when(F.col("label") == "Artist", 1).otherwise(2)
    best = F.min(F.struct(rank.alias("rank"), F.col("id"), F.col("label"))).alias("b")
    # one node for each title first, and columns that lambdas read made before them: else they are made anew for each run of words
    titles = nodes.groupBy("title").agg(best).select("b", F.lower(display(F.col("title"))).alias("t"))
    at = titles.select("b", "t", F.split("t", " ").alias("w"))
    t, w = F.col("t"), F.col("w")
    runs = F.flatten(F.transform(F.sequence(F.lit(2), F.lit(longest)), lambda n: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))))
    ways = F.concat(F.array(t, F.translate(t, "-", " "), F.translate(t, " -", ""), F.translate(t, " ", "-"), F.trim(F.regexp_replace(t, "[0-9]", ""))), runs)
    rows = at.select("b", F.explode(F.array_distinct(ways)).alias("name")).filter(F.length("name") >= 2)
    return rows.groupBy("name").agg(F.min("b").alias("b")).select("name", "b.id", "b.label")


def linked(questions: DataFrame, dictionary: DataFrame, longest: int = 4, most: int = 5) -> DataFrame:
    """(question_id, place, id, name): dictionary names in each question, longer ones first, none inside another, up to ``most``."""
    w = F.filter(F.split(F.regexp_replace(F.lower("question"), r"[.,;:!?\"()]", " "), " "), lambda x: x != "")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1))), lambda i: F.struct(i.alias("start"), (i + n).alias("end"), F.array_join(F.slice("w", i, n), " ").alias("name")))))
    # runs are made once for each text, however many questions have it
    texts = questions.select("question").distinct().select("question", w.alias("w"))
    spots = texts.select("question", F.explode(runs).alias("s")).select("question", "s.*")
    hits = spots.join(dictionary.select("name", "id"), "name").groupBy("question").agg(F.collect_list(F.struct((F.col("start") - F.col("end")).alias("shorter"), "start", "end", "name", "id")).alias("found"))
    hits = questions.select("question_id", "question").join(hits, "question").groupBy("question_id").agg(F.flatten(F.collect_list("found")).alias("all"))
    kept = F.aggregate(F.array_sort("all"), F.slice("all", 1, 0), lambda a, x: F.when(F.exists(a, lambda y: ((y["start"] < x["end"]) & (x["start"] < y["end"])) | (y["name"] == x["name"])), a).otherwise(F.concat(a, F.array(x))))
    return hits.select("question_id", F.posexplode(F.slice(kept, 1, most)).alias("place", "m")).select("question_id", "place", "m.id", "m.name")


def expanded(graph: Graph, seeds: DataFrame, per_seed: int = 10, in_all: int = 30) -> DataFrame:
    """(question_id, place, src, rel_type, dst, score): relations at each question's seeds (question_id, id): +1 for each end among them,
    best ``per_seed`` at each seed and ``in_all`` for each question."""
    edges = graph.edges.select("src", "rel_type", "dst")
    ends = edges.withColumn("end", F.col("src")).unionByName(edges.filter("src <> dst").withColumn("end", F.col("dst")))
    at = seeds.join(ends, F.col("id") == F.col("end"))
    mine = seeds.select(F.col("question_id").alias("q"), F.col("id").alias("other"))
    far = F.when(F.col("id") == F.col("src"), F.col("dst")).otherwise(F.col("src"))
    at = at.withColumn("far", far).join(mine, (F.col("question_id") == F.col("q")) & (F.col("far") == F.col("other")), "left")
    at = at.withColumn("score", F.lit(1.0) + F.when(F.col("other").isNotNull(), 1.0).otherwise(0.0))
    order = [F.desc("score"), "rel_type", "src", "dst"]
    at = at.withColumn("n", F.row_number().over(Window.partitionBy("question_id", "id").orderBy(*order))).filter(F.col("n") <= per_seed)
    at = at.select("question_id", "src", "rel_type", "dst", "score").distinct()
    return at.withColumn("place", F.row_number().over(Window.partitionBy("question_id").orderBy(*order))).filter(F.col("place") <= in_all).select("question_id", "place", "src", "rel_type", "dst", "score")


def reranked(relations: DataFrame, degree: DataFrame, keywords: DataFrame, top: int = 15, least: float = 0.1) -> DataFrame:
    """Relations by .3 for each end named in the question's keywords (question_id, word), up to .2 for the source's degree, .3 for the type."""
    words = keywords.groupBy(F.col("question_id").alias("q")).agg(F.collect_set("word").alias("words"))
    at = relations.join(words, F.col("question_id") == F.col("q"), "left").join(degree.select(F.col("id").alias("i"), "degree"), F.col("src") == F.col("i"), "left")
    has = lambda c: F.coalesce(F.exists("words", lambda w: F.contains(F.lower(c), w)), F.lit(False)).cast("double")
    score = 0.3 * has(F.col("src")) + 0.3 * has(F.col("dst")) + F.least(F.coalesce("degree", F.lit(0)) / 100, F.lit(0.2)) + 0.3 * has(F.col("rel_type"))
    at = at.withColumn("score", F.round(score, 6)).filter(F.col("score") > least)
    w = Window.partitionBy("question_id").orderBy(F.desc("score"), "src", "rel_type", "dst")
    return at.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top).select("question_id", "place", "src", "rel_type", "dst", "score")


def context_text(relations: DataFrame, tokens: int = 500) -> DataFrame:
    """(question_id, text): relations as lines in their order, cut at the last line that fits in about four characters a token."""
    line = F.concat_ws(" ", "src", "rel_type", "dst")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), "\n")
    cut = F.substring("whole", 1, 4 * tokens)
    at = relations.groupBy("question_id").agg(text.alias("whole"))
    return at.select("question_id", F.when(F.length("whole") <= 4 * tokens, F.col("whole")).otherwise(F.regexp_replace(cut, "\n[^\n]*$", "")).alias("text"))


def multi_hop(graph: Graph, seeds: DataFrame, depth: int = 3, per_hop: int = 5) -> DataFrame:
    """(question_id, hop, id): up to ``per_hop`` new nodes a hop, the most often linked first."""
    both = graph.both_ways().select(F.col("id").alias("from"), "nbr")
    level, seen, out = seeds.select("question_id", "id"), seeds.select("question_id", "id"), None
    for k in range(1, depth + 1):
        step = level.join(both, F.col("id") == F.col("from")).groupBy("question_id", F.col("nbr").alias("id")).agg(F.count("*").alias("n")).join(seen, ["question_id", "id"], "left_anti")
        w = Window.partitionBy("question_id").orderBy(F.desc("n"), "id")
        level = step.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= per_hop).select("question_id", "id")
        seen = seen.unionByName(level)
        rows = level.select("question_id", F.lit(k).alias("hop"), "id")
        out = rows if out is None else out.unionByName(rows)
    return out


def intents(questions: DataFrame, rules: list[tuple[str, str]], otherwise: str = "generic") -> DataFrame:
    """(question_id, intent): the first (pattern, intent) rule that matches; the rules are one column expression, so a question is read once."""
    out = F.lit(otherwise)
    for pattern, intent in reversed(rules):
        out = F.when(F.lower("question").rlike(pattern), intent).otherwise(out)
    return questions.select("question_id", out.alias("intent"))


def best_choice(questions: DataFrame) -> DataFrame:
    """(question_id, answer): of ``choices`` the one that the ``facts`` speak for: +10 if they contain it, +2 for each of its words; the first among equals."""
    at = questions.select("question_id", F.lower("facts").alias("facts"), F.posexplode("choices").alias("n", "choice"))
    c = F.lower("choice")
    score = F.when(F.contains("facts", c), 10).otherwise(0) + 2 * F.size(F.filter(F.array_distinct(F.split(c, " ")), lambda w: F.contains(F.col("facts"), w)))
    return at.groupBy("question_id").agg(F.max_by("choice", F.struct(score, -F.col("n"))).alias("answer"))


def history(turns: DataFrame, most: int = 3) -> DataFrame:
    """(conv_id, turn, recent): each turn with the last ``2 * most`` turns before it, oldest first."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-2 * most, -1)
    return turns.select("conv_id", "turn", F.collect_list(F.concat_ws(": ", "role", "text")).over(w).alias("recent"))


def seed_paths(graph: Graph, seeds: DataFrame, most: int = 2, each: int = 3) -> DataFrame:
    """(question_id, src, dst, path): up to ``each`` shortest simple paths between the seeds (question_id, id) of a question."""
    from quern.operators.paths import simple_paths

    both = graph.both_ways().select(F.col("id").alias("src"), F.col("nbr").alias("dst"))
    walks = simple_paths(both, seeds.select("id").distinct(), most)
    a, b = seeds.select("question_id", F.col("id").alias("src")), seeds.select(F.col("question_id").alias("q"), F.col("id").alias("dst"))
    at = walks.join(a, "src").join(b, "dst").filter("question_id = q AND src < dst")
    w = Window.partitionBy("question_id", "src", "dst").orderBy("hops", "path")
    return at.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= each).select("question_id", "src", "dst", "path")


def facts(graph: Graph, sentences: dict[str, str]) -> DataFrame:
    """(id, fact): a sentence for each edge of a type with a template (%s the source's title, %s the target's)."""
    pairs = [F.lit(x) for kv in sentences.items() for x in kv]
    of = lambda x: graph.nodes.select(F.col("id").alias(f"{x}_id"), F.col("title").alias(f"{x}_title"))
    at = graph.of_type(*sentences).join(of("s"), F.col("src") == F.col("s_id")).join(of("d"), F.col("dst") == F.col("d_id"))
    form = F.element_at(F.create_map(*pairs), F.col("rel_type"))
    one = F.split(form, "%s")
    return at.select(F.col("src").alias("id"), F.concat(one[0], "s_title", one[1], "d_title", one[2]).alias("fact"))
