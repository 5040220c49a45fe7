"""Substring dedup by super-k-mer partitioning.

A window is ``k`` consecutive words of one document; its minimiser is the smallest hash among its runs
of ``M`` words. Consecutive windows with one minimiser travel as one packed string, a super-k-mer, to the
minimiser's bucket: equal windows have equal minimisers, so they meet there, and sorting the bucket's
windows (equal hashes are compared word by word) tells each window's first document.

1. Each document's (minimiser, doc_id) pairs; a minimiser of one document only can hold no repeat, and
   only super-k-mers of the others are packed and sent.
2. A minimiser of over ``HOT`` super-k-mers is too much for one bucket. Its super-k-mers with equal words
   become one kind with its first document, by an aggregate that combines within salts before it does
   over them. If it still has over ``HOT`` kinds, these are cut anew by the minimiser under another order of hashes, which
   depends on the window alone, so equal windows still meet; the last of ``LEVELS`` cuts is into single windows.
3. Windows with an earlier document give intervals; a document's words that they cover go.

Rows are told apart by doc_id and a 64-bit hash of their text. Defined results: null text has no words; fewer words than
``k`` lose none; documents without an id, and rows of one id, are no earlier than each other, so they lose nothing to each
other, and a document without an id neither loses words nor makes others lose them; doc_id is read as a long (what
does not cast is no id); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.shared import stored

K, M = 50, 8
#: Windows in one super-k-mer, at most: longer runs of one minimiser are cut.
LONGEST = 256
#: Super-k-mers, or kinds of them, in one bucket, at most, and the cuts of those of larger ones.
HOT, LEVELS = 2000, 4
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
SLICE = 1 << 19


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


class Hashes(dict):
    """Words' 64-bit hashes, each computed once while the memo holds it."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) > 400_000:
            self.clear()
        self[word] = h = xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class Rolling:
    """Hashes of runs of words, from prefix sums of powers: equal runs have equal hashes wherever they stand."""

    def __init__(self, base: int):
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.up = self.down = np.zeros(0, np.uint64)

    def __call__(self, h: np.ndarray, n: int) -> np.ndarray:
        if len(self.up) < len(h):
            size = max(len(h), 1 << 16)
            self.up, self.down = (np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, x, np.uint64))]) for x in (self.base, self.inverse))
        if len(h) < n:
            return np.zeros(0, np.uint64)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * self.up[: len(h)])])
        x = (total[n:] - total[:-n]) * self.down[: len(h) - n + 1]
        x ^= x >> np.uint64(32)
        return x * np.uint64(0xD6E8FEB86659FD93)


def sliding_least(g: np.ndarray, n: int) -> np.ndarray:
    """The least of every ``n`` neighbours."""
    if len(g) < n:
        return g[:0]
    low, width = g, 1
    while 2 * width <= n:
        low, width = np.minimum(low[:-width], low[width:]), 2 * width
    return np.minimum(low[: len(low) - (n - width)], low[n - width :]) if n > width else low


class Cutter:
    """Documents' words and super-k-mers, a slice of documents at a time."""

    def __init__(self, k: int, level: int = 1):
        self.k, self.hashes, self.rolling = k, Hashes(), Rolling(BASES[0])
        self.m, self.level = min(M, k), level

    def cut(self, docs: list[list[bytes]], longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, first window, windows, minimiser) of every super-k-mer of ``longest`` windows at most."""
        sizes = np.array([len(w) for w in docs], np.int64)
        first = np.cumsum(sizes) - sizes
        h = self.hashes.of([w for d in docs for w in d])
        runs = self.rolling(h, self.m)
        if self.level > 1:  # another order of the same runs
            runs = (runs ^ (runs >> np.uint64(29))) * np.uint64(BASES[0] + 2 * self.level)
            runs ^= runs >> np.uint64(32)
        low = sliding_least(runs, self.k - self.m + 1)
        full = np.maximum(sizes - self.k + 1, 0)
        doc = np.repeat(np.arange(len(docs)), full)
        place = np.arange(len(doc)) - np.repeat(np.cumsum(full) - full, full)
        low = low[first[doc] + place]
        new = np.r_[True, (doc[1:] != doc[:-1]) | (low[1:] != low[:-1])][: len(doc)]
        starts = np.flatnonzero(new)
        since = np.arange(len(doc)) - np.repeat(starts, np.diff(np.append(starts, len(doc))))
        starts = np.flatnonzero(since % longest == 0)
        return doc[starts], place[starts], np.diff(np.append(starts, len(doc))), low[starts].view(np.int64)


def _sliced(batch: pa.RecordBatch, column: int = 1) -> Iterator[tuple[int, int, list[list[bytes]]]]:
    """(from, to, words of each document) with about ``SLICE`` words at a time."""
    a, n, words = 0, 0, []
    for i, t in enumerate(_texts(batch.column(column))):
        words.append(t.split())
        n += len(words[-1])
        if n >= SLICE:
            yield a, i + 1, words
            a, n, words = i + 1, 0, []
    if words:
        yield a, a + len(words), words


def _row(docs: DataFrame) -> DataFrame:
    """A row's key: its id and a hash of its text, since rows of one id may have different texts."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text").filter("doc_id IS NOT NULL AND text IS NOT NULL")


def _minimisers(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, row, mini, n): each row's minimisers with the number of their super-k-mers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(k)
        for batch in batches:
            for a, b, words in _sliced(batch, 2):
                doc, _, _, low = cutter.cut(words)
                order = np.lexsort((low, doc))
                doc, low = doc[order], low[order]
                new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (low[1:] != low[:-1])][: len(doc)])
                at = pa.array(doc[new])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a).take(at) for c in (0, 1)), pa.array(low[new]), pa.array(np.diff(np.append(new, len(doc))).astype(np.int64))], ["doc_id", "row", "mini", "n"])

    return docs.mapInArrow(run, "doc_id long, row long, mini long, n long")


def _packed(docs: DataFrame, k: int) -> DataFrame:
    """Super-k-mers of the minimisers in ``docs.shared`` (structs of minimiser and salts): (own, row, at, first, key, salts, packed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(k)
        for batch in batches:
            marks = batch.column(3)
            for a, b, words in _sliced(batch, 2):
                doc, start, n, low = cutter.cut(words)
                part = marks.slice(a, b - a)
                flat, sizes = part.flatten(), np.diff(part.offsets.to_numpy())
                owner = np.repeat(np.arange(b - a), sizes)
                mini, salts = (flat.field(i).to_numpy() for i in (0, 1))
                # a document's own marks, found by (document, minimiser)
                order = np.lexsort((mini, owner))
                key = np.zeros(len(order), [("d", np.int64), ("m", np.int64)])
                key["d"], key["m"] = owner[order], mini[order]
                want = np.zeros(len(doc), key.dtype)
                want["d"], want["m"] = doc, low
                at = np.minimum(np.searchsorted(key, want), max(len(key) - 1, 0))
                hit = np.flatnonzero(key[at] == want) if len(key) and len(want) else np.zeros(0, np.int64)
                packed = [b" ".join(words[d][s : s + m + k - 1]) for d, s, m in zip(doc[hit].tolist(), start[hit].tolist(), n[hit].tolist(), strict=True)]
                ids, rows = (batch.column(c).slice(a, b - a).take(pa.array(doc[hit])) for c in (0, 1))
                yield pa.RecordBatch.from_arrays([ids, rows, pa.array(start[hit]), ids, pa.array(low[hit]), pa.array(salts[order][at[hit]]), pa.array(packed, pa.binary())], ROWS)

    return docs.mapInArrow(run, ROWS_DDL)


#: Super-k-mers to settle: whose they are, where they start there, the first document known, their bucket, its salts, and their words.
ROWS = ["own", "row", "at", "first", "key", "salts", "packed"]
ROWS_DDL = "own long, row long, at long, first long, key long, salts long, packed binary"
SPANS_DDL = "own long, row long, start long, n long"


class Bucket:
    """The windows of some super-k-mers: their hashes, documents and places, sorted."""

    def __init__(self, packed: list[bytes], doc: np.ndarray, start: np.ndarray, k: int, hashes: Hashes, rolling: list[Rolling]):
        words = [p.split() for p in packed]
        flat = [w for d in words for w in d]
        sizes = np.array([len(w) for w in words], np.int64)
        h = hashes.of(flat)
        number: dict[bytes, int] = {}
        self.k, self.ids = k, np.fromiter((number.setdefault(w, len(number)) for w in flat), np.int32, len(flat))
        full = np.maximum(sizes - k + 1, 0)
        row = np.repeat(np.arange(len(words)), full)
        place = np.arange(len(row)) - np.repeat(np.cumsum(full) - full, full)
        self.at = (np.cumsum(sizes) - sizes)[row] + place
        self.h = [r(h, k)[self.at] for r in rolling]
        self.doc, self.start = doc[row], start[row] + place
        order = np.lexsort((self.start, self.doc, self.h[1], self.h[0]))
        self.at, self.doc, self.start, self.row = self.at[order], self.doc[order], self.start[order], row[order]
        self.h = [x[order] for x in self.h]
        n = len(order)
        new = np.r_[True, (self.h[0][1:] != self.h[0][:-1]) | (self.h[1][1:] != self.h[1][:-1])][:n]
        self.heads = np.flatnonzero(new)
        self.head = np.repeat(self.heads, np.diff(np.append(self.heads, n)))
        self._compare()
        self.first = self.doc[self.head]

    def _compare(self) -> None:
        """Every window against its run's head, word by word; a run whose windows differ is told apart by its words."""
        later = np.flatnonzero(self.head != np.arange(len(self.head)))
        for a in range(0, len(later), 1 << 16):
            part = later[a : a + (1 << 16)]
            same = np.ones(len(part), bool)
            for j in range(self.k):
                same &= self.ids[self.at[part] + j] == self.ids[self.at[self.head[part]] + j]
            for i in part[~same].tolist():
                own = self.ids[self.at[i] : self.at[i] + self.k]
                run = range(self.head[i], i + 1)
                self.head[i] = next(x for x in run if (self.ids[self.at[x] : self.at[x] + self.k] == own).all())


def _intervals(own: np.ndarray, row: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """Windows as (own, row, start, windows) of consecutive ones."""
    order = np.lexsort((start, row, own))
    own, row, start = own[order], row[order], start[order]
    new = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)][: len(own)])
    return pa.RecordBatch.from_arrays([pa.array(own[new]), pa.array(row[new]), pa.array(start[new]), pa.array(np.diff(np.append(new, len(own))).astype(np.int64))], ["own", "row", "start", "n"])


def _buckets(batches: Iterator[pa.RecordBatch], most: int = 16_000_000) -> Iterator[pa.RecordBatch]:
    """Batches sorted by ``key`` joined so that no bucket's rows are parted, with about ``most`` bytes at a time."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.nbytes
        if n >= most:
            t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            key = t.column(4).to_numpy()
            other = np.flatnonzero(key != key[-1])
            if len(other):
                cut = int(other[-1]) + 1
                yield t.slice(0, cut)
                t = t.slice(cut)
            held, n = [t], t.nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _settled(rows: DataFrame, k: int) -> DataFrame:
    """(own, row, start, n): windows of ``rows`` that a row of the same bucket with a smaller ``first`` has, bucket by bucket."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = Hashes(), [Rolling(b) for b in BASES]
        for t in _buckets(batches):
            b = Bucket(t.column(6).to_pylist(), t.column(3).to_numpy(), t.column(2).to_numpy(), k, *tools)
            late = np.flatnonzero(b.doc > b.first)
            own, row = (t.column(c).to_numpy()[b.row[late]] for c in (0, 1))
            yield _intervals(own, row, b.start[late])

    return rows.select(*ROWS).repartition("key").sortWithinPartitions("key").mapInArrow(settle, SPANS_DDL)


def _recut(rows: DataFrame, k: int, level: int, levels: int) -> DataFrame:
    """``rows`` in pieces whose bucket is the minimiser under another order; on the last level each window is a piece and a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        cutter = Cutter(k, level)
        for batch in batches:
            packed = [p.split() for p in batch.column(6).to_pylist()]
            doc, start, n, low = cutter.cut(packed, 1 if level >= levels else LONGEST)
            pieces = [b" ".join(packed[d][s : s + m + k - 1]) for d, s, m in zip(doc.tolist(), start.tolist(), n.tolist(), strict=True)]
            if level >= levels:
                low = np.fromiter(map(xxh64_intdigest, pieces), np.uint64, len(pieces)).view(np.int64)
            at = pa.array(doc)
            own, row, first = (batch.column(c).take(at) for c in (0, 1, 3))
            yield pa.RecordBatch.from_arrays([own, row, pa.array(batch.column(2).to_numpy()[doc] + start), first, pa.array(low), pa.array(np.ones(len(low), np.int64)), pa.array(pieces, pa.binary())], ROWS)

    return rows.select(*ROWS).mapInArrow(run, ROWS_DDL)


def _marked_hot(rows: DataFrame, hot: int) -> DataFrame:
    """``rows`` with ``many``, the number of rows of their bucket where that is over ``hot`` (else null)."""
    over = rows.groupBy(F.col("key").alias("h_key")).agg(F.count("*").alias("many")).filter(F.col("many") > hot)
    return rows.join(over, F.col("key") == F.col("h_key"), "left").drop("h_key")


def _hot(rows: DataFrame, k: int, hot: int, level: int, levels: int) -> DataFrame:
    """(own, row, start, n): the late windows of rows whose buckets are too large for one task.

    Rows with equal words become one kind, first within a bucket's salts, then over them; a row that is later than
    its kind's first document is late as a whole. Kinds of a bucket that is small now are settled in it, those of others
    are cut anew by another minimiser, which equal windows share too, and so on; the last level's pieces are single
    windows, and equal ones one kind.
    """
    mine = [F.pmod(F.xxhash64("own", "row", "at"), F.col("salts")).alias("salt")]
    rows = rows.select("*", *mine)
    part = stored(rows.groupBy("key", "salt", "packed").agg(F.min("first").alias("least")), f"kinds-in-part-{level}")
    kinds = stored(part.groupBy("key", "packed").agg(F.min("least").alias("first")).select(F.monotonically_increasing_id().alias("kind"), "key", "packed", "first"), f"kinds-{level}")
    whole = kinds.select(F.col("key").alias("w_key"), F.col("packed").alias("w_packed"), "kind", F.col("first").alias("least"))
    known = part.select("key", "salt", "packed").join(whole, (F.col("key") == F.col("w_key")) & (F.col("packed") == F.col("w_packed")))
    known = known.select(F.col("key").alias("k_key"), F.col("salt").alias("k_salt"), F.col("w_packed").alias("k_packed"), "kind", "least")
    placed = rows.join(known, (F.col("key") == F.col("k_key")) & (F.col("salt") == F.col("k_salt")) & (F.col("packed") == F.col("k_packed")))
    words = F.length("packed") - F.length(F.replace(F.col("packed").cast("string"), F.lit(" "), F.lit("")).cast("binary")) + 1
    placed = stored(placed.select("own", "row", "at", (words - k + 1).cast("long").alias("windows"), (F.col("first") > F.col("least")).alias("late"), "kind"), f"placed-{level}")
    out = placed.filter("late").select("own", "row", F.col("at").alias("start"), F.col("windows").alias("n"))
    if level >= levels:
        return out
    sized = _marked_hot(kinds, hot).select(F.col("kind").alias("own"), F.lit(0).cast("long").alias("row"), F.lit(0).cast("long").alias("at"), "first", "key", F.lit(1).cast("long").alias("salts"), "packed", "many")
    sized = stored(sized, f"sized-{level}")
    inner = _settled(sized.filter("many IS NULL"), k)
    if sized.filter("many IS NOT NULL").limit(1).count():
        pieces = stored(_recut(sized.filter("many IS NOT NULL"), k, level + 1, levels), f"pieces-{level + 1}")
        pieces = _marked_hot(pieces, hot).withColumn("salts", F.ceil(F.coalesce("many", F.lit(1)) / F.lit(hot)).cast("long")).select(*ROWS)
        inner = inner.unionByName(_hot(pieces, k, hot, level + 1, levels))
    inner = inner.select(F.col("own").alias("i_kind"), F.col("start").alias("i_start"), F.col("n").alias("i_n"))
    rest = placed.filter("NOT late").join(inner, F.col("kind") == F.col("i_kind"))
    return out.unionByName(rest.select("own", "row", (F.col("at") + F.col("i_start")).alias("start"), F.col("i_n").alias("n")))


def repeats(docs: DataFrame, k: int = K, hot: int = HOT, levels: int = LEVELS) -> DataFrame:
    """(_sub_id, _sub_row, _sub_spans): for each row with a window that starts in an earlier document, structs (start, n) of such windows."""
    own = _row(docs)
    pairs = stored(_minimisers(own, k), "minimisers")
    shared = pairs.groupBy("mini").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.sum("n").alias("n")).filter("a < b")
    shared = shared.select(F.col("mini").alias("m"), F.ceil(F.col("n") / F.lit(hot)).cast("long").alias("salts"))
    marks = pairs.join(shared, F.col("mini") == F.col("m")).groupBy(F.col("doc_id").alias("_sub_id"), F.col("row").alias("_sub_row")).agg(F.collect_set(F.struct("m", "salts")).alias("shared"))
    packed = own.join(marks, (F.col("doc_id") == F.col("_sub_id")) & (F.col("row") == F.col("_sub_row"))).select("doc_id", "row", "text", "shared")
    packed = stored(_packed(packed, k), "super-k-mers")
    spans = _settled(packed.filter("salts = 1"), k)
    if packed.filter("salts > 1").limit(1).count():
        spans = spans.unionByName(_hot(packed.filter("salts > 1"), k, hot, 1, levels))
    return spans.groupBy(F.col("own").alias("_sub_id"), F.col("row").alias("_sub_row")).agg(F.collect_list(F.struct("start", "n")).alias("_sub_spans"))


def _with_spans(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with ``_sub_spans`` where the row has some."""
    return docs.join(found, (F.col("doc_id") == F.col("_sub_id")) & (F.xxhash64("text") == F.col("_sub_row")), "left")


def kept_words(words: list[bytes], spans: list[dict] | None, k: int) -> tuple[list[bytes], int]:
    if not spans:
        return words, 0
    edge = np.zeros(len(words) + 1, np.int64)
    for s in spans:
        edge[s["start"]] += 1
        edge[s["start"] + s["n"] + k - 1] -= 1
    keep = np.cumsum(edge)[:-1] == 0
    return [w for w, x in zip(words, keep.tolist(), strict=True) if x], int((~keep).sum())


def without_repeats(docs: DataFrame, k: int = K, hot: int = HOT, keep_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row of ``docs``; with ``keep_text`` also the kept words, joined by spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, a = batch.column(2).to_pylist(), 0
            for a, b, words in _sliced(batch):
                rows = [kept_words(w, s, k) for w, s in zip(words, spans[a:b], strict=True)]
                texts = [b" ".join(w) for w, _ in rows]
                made = [batch.column(0).slice(a, b - a), pa.array([len(w) for w in words], pa.int64()), pa.array([n for _, n in rows], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
                if keep_text:
                    made.append(pa.array(texts, pa.binary()).cast(pa.string()))
                    names.append("kept")
                yield pa.RecordBatch.from_arrays(made, names)

    found = _with_spans(docs.select("doc_id", "text"), repeats(docs, k, hot)).select("doc_id", "text", "_sub_spans")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text)


def trimmed(docs: DataFrame, k: int = K, hot: int = HOT) -> DataFrame:
    """``docs`` with the repeated words taken out of their texts.

    Texts that lose nothing stay as they are; documents that lose every word go.
    """
    names = docs.columns
    at, sized = names.index("text"), names.index("n_chars") if "n_chars" in names else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            keep = []
            for i, s in enumerate(spans):
                if s:
                    left, _ = kept_words(texts[i].encode().split(), s, k)
                    texts[i] = b" ".join(left).decode()
                keep.append(not s or bool(texts[i]))
            out = batch.columns[:-1]
            out[at] = pa.array(texts, batch.column(at).type)
            if sized >= 0:
                out[sized] = pa.array([n if not s else len(t) for n, s, t in zip(out[sized].to_pylist(), spans, texts, strict=True)], out[sized].type)
            yield pa.RecordBatch.from_arrays(out, names).filter(pa.array(keep))

    found = _with_spans(docs, repeats(docs, k, hot))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns], "_sub_spans").mapInArrow(run, docs.schema)


#: The same in DuckDB, window by window.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM d WHERE len(w) >= 50)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first FROM win) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS p FROM hit),
each AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT each.doc_id, count(*) AS n_words, count(gone.p) AS n_removed, string_agg(x, ' ' ORDER BY each.p) FILTER (gone.p IS NULL) AS t
         FROM each LEFT JOIN gone ON each.doc_id = gone.doc_id AND each.p = gone.p GROUP BY 1)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
