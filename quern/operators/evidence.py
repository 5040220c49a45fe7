"""What a text or a field has to show before a relation or a role counts, and entities tagged by a model."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Tagger = Callable[[list[str]], list[list[tuple[str, str, float]]]]

# Keywords that tell what a tagged organisation or work is.
COMPANY_WORDS = ["entertainment", "music", "media", "label", "agency", "công ty", "hãng"]
ALBUM_WORDS = ["album", "ep", "mini-album"]
SONG_WORDS = ["song", "bài hát", "ca khúc", "single"]


@dataclass(frozen=True)
class Evidence:
    """What a relation needs: the ends' types, their starts at most ``far`` characters apart, and either a template
    ({s} and {t} stand for the names) that the context matches or a keyword between the names. ``only`` names the
    sources that are allowed (all, if None)."""

    sources: tuple[str, ...]
    targets: tuple[str, ...]
    far: int
    templates: tuple[str, ...] = ()
    keywords: tuple[str, ...] = ()
    only: tuple[str, ...] | None = None


# Types, distances and keywords of the relations.
RULES = {
    "MEMBER_OF": Evidence(("Artist",), ("Group",), 180, (r"{s}\s+(?:is\s+)?(?:a\s+)?member\s+of\s+{t}", r"{s}\s+left\s+{t}"), ("thành viên", "member", "gồm", "comprising", "consists of")),
    "RELEASED": Evidence(("Artist", "Group"), ("Album",), 150, (), ("phát hành", "ra mắt", "released", "tung ra")),
    "SINGS": Evidence(("Artist", "Group"), ("Song",), 120, (), ("hát", "trình bày", "thể hiện", "ca khúc của", "bài hát của", "title track", "phát hành single", "ra mắt single", "released the single", "released the song")),
    "CONTAINS": Evidence(("Album",), ("Song",), 150, (), ("chứa", "bao gồm", "gồm có", "includes", "contains", "trong album", "nằm trong", "ca khúc chủ đề", "title track", "trích từ", "thuộc album", "từ album")),
    "MANAGED_BY": Evidence(("Artist", "Group"), ("Company",), 130, (), ("thuộc", "trực thuộc", "quản lý bởi", "under", "signed with", "ký hợp đồng", "được thành lập", "thành lập bởi", "formed by", "managed by", "dưới trướng", "công ty", "hãng", "entertainment")),
    "PRODUCE_SONG": Evidence(("Artist",), ("Song",), 1 << 30, (), ("sản xuất", "produced", "producer", "produce")),
    "PRODUCE_ALBUM": Evidence(("Artist",), ("Album",), 1 << 30, (), ("sản xuất", "produced", "producer", "produce", "executive producer")),
    "WROTE": Evidence(("Artist",), ("Song",), 1 << 30, (), ("sáng tác", "viết lời", "wrote", "composed", "tác giả")),
    "SUBUNIT_OF": Evidence(("Group",), ("Group",), 130, (), ("nhóm nhỏ", "subunit", "sub-unit", "tách ra từ", "được tách từ")),
}


def _template(template: str, names: dict[str, Column]) -> Column:
    """The pattern with both names quoted in their places."""
    quoted = lambda c: F.concat(F.lit("\\Q"), F.replace(c, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return F.concat(*[quoted(names[p]) if p in names else F.lit(p) for p in re.split(r"(\{[st]\})", template) if p])


def directed(rows: DataFrame, rules: dict[str, Evidence] | None = None) -> DataFrame:
    """Rows (src, src_type, dst, dst_type, rel_type, context) whose context bears out that direction. Rows of a
    relation without a rule go, as do those with a null, an empty name, or a name that the context lacks."""
    text, s, t = (F.lower(c) for c in ("context", "src", "dst"))
    a, b = F.position(s, text), F.position(t, text)
    between = F.substring(text, F.least(a, b), F.abs(a - b))
    holds = F.lit(False)
    for rel, rule in (RULES if rules is None else rules).items():
        shown = F.lit(False)
        for template in rule.templates:
            shown |= F.regexp_like(text, _template(template, {"{s}": s, "{t}": t}))
        for word in rule.keywords:
            shown |= F.contains(between, F.lit(word))
        typed = F.col("src_type").isin(*rule.sources) & F.col("dst_type").isin(*rule.targets)
        allowed = F.lit(True) if rule.only is None else s.isin(*rule.only)
        holds = F.when(F.col("rel_type") == rel, typed & allowed & (F.abs(a - b) <= rule.far) & shown).otherwise(holds)
    return rows.filter((F.length("src") > 0) & (F.length("dst") > 0) & (a > 0) & (b > 0)).filter(holds)


def pairs_in_context(docs: DataFrame, spans: DataFrame, most: int) -> DataFrame:
    """(doc_id, src, src_type, dst, dst_type, context): both directions of every two spans (doc_id, start, name, type)
    of the whole text whose starts, from 1, are at most ``most`` characters apart; the context runs from the first span to the end of the second."""
    a, b = (spans.select(F.col("doc_id").alias(f"{x}_doc"), *[F.col(c).alias(f"{x}_{c}") for c in ("start", "name", "type")]) for x in "ab")
    a = a.withColumn("cell", F.explode(F.array(F.floor(F.col("a_start") / most), F.floor(F.col("a_start") / most) + 1)))
    b = b.withColumn("b_cell", F.floor(F.col("b_start") / most))
    near = a.join(b, (F.col("a_doc") == F.col("b_doc")) & (F.col("cell") == F.col("b_cell")) & (F.col("b_start") - F.col("a_start")).between(1, most) & (F.col("a_name") != F.col("b_name")))
    at = near.join(docs.select("doc_id", "text"), F.col("a_doc") == F.col("doc_id"))
    at = at.withColumn("context", F.substring(F.col("text"), F.col("a_start"), F.col("b_start") - F.col("a_start") + F.length("b_name")))
    forth, back = (at.select("doc_id", F.col(f"{x}_name").alias("src"), F.col(f"{x}_type").alias("src_type"), F.col(f"{y}_name").alias("dst"), F.col(f"{y}_type").alias("dst_type"), "context") for x, y in ("ab", "ba"))
    return forth.unionByName(back)


def by_occupation(people: DataFrame, keywords: dict[str, list[str]], base: dict[str, list[str]]) -> DataFrame:
    """(role, name): lower-cased names of people (name, occupation) whose occupation has a role's keyword, and each role's known names."""
    roles = F.array_compact(F.array(*[F.when(F.lower("occupation").rlike("|".join(map(re.escape, words))), F.lit(role)) for role, words in keywords.items()]))
    found = people.select(F.explode(roles).alias("role"), F.lower("name").alias("name"))
    known = people.sparkSession.createDataFrame([(role, n.lower()) for role, names in base.items() for n in names], "role string, name string")
    return found.unionByName(known).distinct()


def parts_at_spaces(text: str, size: int = 2000) -> list[str]:
    """A text in parts of up to ``size`` characters, cut at the last space of a part where its last fifth has one."""
    parts, at = [], 0
    while at < len(text):
        end = at + size
        space = text.rfind(" ", at, end) if end < len(text) else -1
        cut = space if space - at > 0.8 * size else min(end, len(text))
        parts.append(text[at:cut])
        at = cut + (cut == space)
    return parts


def kind_of(text: Column, label: Column) -> Column:
    """The entity type for a model's label: people are artists, organisations companies or groups, other names albums or songs by their words, else null."""
    has = lambda words: F.lower(text).rlike("|".join(map(re.escape, words)))
    label = F.upper(label)
    return (
        F.when(label.rlike("PERSON|^([BI]-)?PER$"), "Artist")
        .when(F.contains(label, F.lit("ORG")), F.when(has(COMPANY_WORDS), "Company").otherwise("Group"))
        .when(F.contains(label, F.lit("MISC")), F.when(has(ALBUM_WORDS), "Album").when(has(SONG_WORDS), "Song"))
    )


def tagged(docs: DataFrame, tagger: Tagger, least: float = 0.65) -> DataFrame:
    """(doc_id, type, text, confidence): the best of each name that ``tagger`` finds in whole texts.

    ``tagger`` may hold any model; it takes the parts of a text and gives (name, label, score) of each part's
    finds. Confidence is nine tenths of the score, .95 at most. Null and blank texts have none.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(doc_id, *x) for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True) for part in tagger(parts_at_spaces(text)) for x in part]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pd.DataFrame({c: pd.Series(v, dtype=kind) for c, v, kind in zip(("doc_id", "name", "label", "score"), columns, (frame["doc_id"].dtype, object, object, float), strict=True)})

    rows = docs.filter(F.length(F.trim("text")) >= 3).select("doc_id", "text").mapInPandas(run, f"doc_id {id_type}, name string, label string, score double")
    edge = r"""[.,;:!?"'()\[\]{}]+"""
    name = F.trim(F.regexp_replace(F.regexp_replace(F.trim("name"), f"^{edge}|{edge}$", ""), r"\s+", " "))
    rows = rows.select("doc_id", kind_of(name, F.col("label")).alias("type"), name.alias("text"), F.least(F.lit(0.95), F.col("score") * 0.9).alias("confidence"))
    rows = rows.filter(F.col("type").isNotNull() & F.length("text").between(2, 50) & (F.col("confidence") >= least))
    return rows.groupBy("doc_id", "type", "text").agg(F.max("confidence").alias("confidence"))
