"""Web pages: links, text, sections and infoboxes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def links(pages: DataFrame) -> DataFrame:
    """(page_id, place, href): a page's links in their order."""
    return pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)).alias("place", "href"))


def text(html: Column) -> Column:
    """A page's text: scripts, styles, navigation, comments and tags out, footnote numbers out, white space single."""
    out = F.regexp_replace(html, r"(?s)<(script|style|nav)[^>]*>.*?</(script|style|nav)>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    out = F.regexp_replace(out, r"\[[0-9]+\]", "")
    out = F.replace(F.replace(F.replace(F.replace(out, F.lit("&nbsp;"), F.lit(" ")), F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
    return F.trim(F.regexp_replace(out, r"[ \t\n\r]+", " "))


#: Fields whose values are the linked names only, and keys with the ones they are kept under.
LINKED = ("hãng đĩa", "thể loại", "thành viên", "cựu thành viên", "sáng tác", "sản xuất", "label", "labels", "genre", "genres", "members", "past members", "producer", "composer", "website")
KEYS = {"thành viên": "Current members", "members": "Current members", "current members": "Current members", "cựu thành viên": "Past members", "past members": "Past members", "former members": "Past members", "hợp tác với": "Associated acts", "associated acts": "Associated acts"}


class _Infobox(HTMLParser):
    """Rows of the first table whose class has ``infobox``."""

    def __init__(self) -> None:
        super().__init__()
        self.rows: dict[str, str] = {}
        self.depth, self.cell, self.key = 0, "", ""
        self.parts: list[str] = []
        self.linked: list[str] = []
        self.in_link = self.skip = self.done = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if tag == "table" and not self.done and (self.depth or "infobox" in (a.get("class") or "")):
            self.depth += 1
        elif self.depth and tag in ("th", "td"):
            self.cell, self.parts, self.linked = tag, [], []
        elif self.depth and tag == "sup":
            self.skip = True
        elif self.depth and tag == "a":
            self.in_link = True
            self.linked.append("")
        elif self.depth and tag in ("br", "li"):
            self.parts.append(", ")

    def handle_endtag(self, tag: str) -> None:
        if tag == "table" and self.depth:
            self.depth -= 1
            self.done = not self.depth
        elif tag == "sup":
            self.skip = False
        elif tag == "a":
            self.in_link = False
        elif tag == "th" and self.cell == "th":
            self.key, self.cell = clean("".join(self.parts)), ""
        elif tag == "td" and self.cell == "td":
            value = ", ".join(x.strip() for x in self.linked if x.strip()) if self.key.lower() in LINKED and any(x.strip() for x in self.linked) else "".join(self.parts)
            if self.key and (value := clean(value)):
                self.rows[self.key] = value
            self.cell = self.key = ""

    def handle_data(self, data: str) -> None:
        if self.cell and not self.skip:
            self.parts.append(data)
            if self.in_link:
                self.linked[-1] += data


def clean(value: str) -> str:
    """White space single, footnotes out, joined words opened (``PopRock`` to ``Pop Rock``), no comma at the ends or twice."""
    value = re.sub(r"\[[^\]]*\]", "", value.replace("\xa0", " "))
    value = re.sub(r"(?<=[a-zà-ỹ])(?=[A-ZĐ])", " ", value)
    value = re.sub(r"\s+", " ", value)
    return re.sub(r"(\s*,\s*)+", ", ", value).strip(" ,")


def infobox(html: str) -> dict[str, str]:
    p = _Infobox()
    p.feed(html or "")
    return p.rows


def infoboxes(pages: DataFrame) -> DataFrame:
    """(page_id, infobox): each page's infobox as a map, parsed in Arrow batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"page_id": frame["page_id"], "infobox": frame["html"].map(infobox)})

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, infobox map<string,string>")


def member_fields(boxes: DataFrame) -> DataFrame:
    """(page_id, infobox): only the member fields, under their kept keys."""
    pairs = [F.lit(x) for kv in KEYS.items() for x in kv]
    rows = boxes.select("page_id", F.explode("infobox").alias("k", "v")).withColumn("key", F.element_at(F.create_map(*pairs), F.lower("k"))).filter("key IS NOT NULL")
    joined = rows.groupBy("page_id", "key").agg(F.array_join(F.array_sort(F.collect_set("v")), ", ").alias("v"))
    return joined.groupBy("page_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "v")))).alias("infobox"))


def corpus(pages: DataFrame, least: int = 500) -> DataFrame:
    """(page_id, url, text, text_length) of pages with enough text."""
    at = pages.select("page_id", "url", text(F.col("html")).alias("text")).withColumn("text_length", F.length("text"))
    return at.filter(F.col("text_length") >= least)


class _Description(HTMLParser):
    """The text and links of the headers of class ``infobox-header description``."""

    def __init__(self) -> None:
        super().__init__()
        self.headers: list[tuple[list[str], list[str]]] = []
        self.inside = self.linked = False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "th":
            self.inside = {"infobox-header", "description"} <= set((dict(attrs).get("class") or "").split())
            if self.inside:
                self.headers.append(([], []))
        elif tag == "a" and self.inside:
            self.linked = True
            self.headers[-1][1].append("")

    def handle_endtag(self, tag: str) -> None:
        if tag == "th":
            self.inside = self.linked = False
        elif tag == "a":
            self.linked = False

    def handle_data(self, data: str) -> None:
        if self.inside:
            self.headers[-1][0].append(data)
            if self.linked:
                self.headers[-1][1][-1] += data


def description(html: str | None) -> tuple[str, str, str | None]:
    """The first description, the names linked after its "của", and the album that a description says a song is from."""
    p = _Description()
    p.feed(html or "")
    found = [("".join(parts), [x.strip() for x in links if x.strip()]) for parts, links in p.headers]
    text, links = found[0] if found else ("", [])
    by = [x for x in links if text.find(x) > text.find("của")] if "của" in text else []
    album = next((", ".join(x for x in some if x.lower() not in {"album", "ep"}) for whole, some in found if re.search("từ ?(album|EP|ep)", whole)), "")
    return re.sub(r"\s+", " ", text).strip(), ", ".join(dict.fromkeys(by)), album or None


def descriptions(pages: DataFrame) -> DataFrame:
    """(page_id, description, performed_by, album) of each page's infobox, parsed in Arrow batches."""
    id_type = pages.schema["page_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [description(h) for h in frame["html"]]
            yield pd.DataFrame({"page_id": frame["page_id"], **{c: pd.Series([r[i] for r in rows], dtype=object) for i, c in enumerate(("description", "performed_by", "album"))}})

    return pages.select("page_id", "html").mapInPandas(run, f"page_id {id_type}, description string, performed_by string, album string")
