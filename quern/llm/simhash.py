"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A 64-bit fingerprint is eight positional bytes. Two fingerprints that differ in at most ``bits`` bits
differ in at most ``bits`` bytes, so they share at least ``8 - bits`` positional bytes: the guaranteed
minimum of matches. Single-byte postings would be as long as a 256th of the corpus; instead a posting
is keyed by ``level`` positional bytes out of the first ``bits + level``, of which every pair that
reaches the minimum shares at least one. Within a posting list the shared positional bytes of each
pair are tallied, pairs short of the minimum are dropped, and the others are verified bit by bit.

Equal fingerprints are one entry, whatever the number of documents. ``level`` follows the number of
entries, so that lists stay short. A list of over ``LONG`` entries is not paired up: its entries are
entered again under every choice of ``8 - bits`` positions, where the rest of a fingerprint is
``8 * bits`` free bits, and each entry looks up its neighbours within ``bits`` flips of those.
Lists give links enough to connect what belongs together (a spanning forest), never all pairs.

Defined results: null, empty and blank texts have no words and fingerprint zero, which links like any
other; fewer words than a shingle are one shingle; rows of equal doc_id each give a row; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.components import components, forest
from quern.llm.shared import stored

SEED = 42
#: Entries of a posting list that are compared in pairs, at most.
LONG = 2048


def fingerprint(texts: list[bytes | None], words: int = 3) -> np.ndarray:
    """64-bit fingerprints of UTF-8 texts over shingles of ``words`` words, repeats counted."""
    from xxhash import xxh64_intdigest

    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        w = (t or b"").lower().split()
        if len(w) < words:
            rows = [b" ".join(w)] if w else []
        else:
            line = b" ".join(w)
            ends = np.cumsum([len(x) + 1 for x in w])
            starts = np.concatenate([[0], ends[:-1]])
            rows = [line[a:b] for a, b in zip(starts[: len(w) - words + 1].tolist(), (ends[words - 1 :] - 1).tolist())]
        counts[i] = len(rows)
        hashes += [xxh64_intdigest(r, SEED) for r in rows]
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        starts = (np.cumsum(counts) - counts)[full]
        h = np.array(hashes, np.uint64)
        ones = np.zeros((len(full), 64), np.int64)
        ends = np.append(starts[1:], len(h))
        step = 1 << 16  # bits of so many shingles at a time
        for a in range(0, len(h), step):
            b = min(a + step, len(h))
            first, last = np.searchsorted(ends, a, "right"), np.searchsorted(starts, b, "left")
            bits = np.unpackbits(h[a:b].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones[first:last] += np.add.reduceat(bits, np.maximum(starts[first:last] - a, 0), axis=0, dtype=np.int64)
        over = (2 * ones > counts[full][:, None]).astype(np.uint8)
        out[full] = np.packbits(over, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def _texts(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, bits) for every row: the fingerprint as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, a, n = _texts(batch.column(1)), 0, 0
            for i, t in enumerate(texts):
                n += len(t or b"")
                if n > 1_000_000 or i + 1 == len(texts):
                    made = fingerprint(texts[a : i + 1], words)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, i + 1 - a), pa.array(made.view(np.int64))], ["doc_id", "bits"])
                    a, n = i + 1, 0

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, bits long")


def masks(level: int, bits: int) -> list[int]:
    """The fingerprint masks of every choice of ``level`` positional bytes out of the first ``bits + level``."""
    return [sum(0xFF << 8 * p for p in c) for c in combinations(range(bits + level), level)]


def level_for(n: int, bits: int) -> int:
    """The shortest postings key at which lists of ``n`` scattered entries hold a few entries at most."""
    return next((k for k in range(1, 8 - bits) if n <= 4 << 8 * k), 8 - bits)


def pairs_within(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among the entries of one list: tally shared bytes, keep the guaranteed minimum, verify."""
    least, a_out, b_out = 8 - bits, [], []
    for i in range(0, len(values), 256):
        other = values[i:]
        x = values[i : i + 256, None] ^ other[None, :]
        shared = (x.view(np.uint8).reshape(*x.shape, 8) == 0).sum(2)
        a, b = np.nonzero(np.triu(shared >= least, 1))
        near = np.bitwise_count(x[a, b]) <= bits
        a_out.append(i + a[near])
        b_out.append(i + b[near])
    return np.concatenate(a_out), np.concatenate(b_out)


def short_runs(key: np.ndarray, values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal key, all runs at once: each entry with the next, the second next and so on."""
    least, a_out, b_out = 8 - bits, [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    live = np.arange(len(key))
    for step in range(1, len(key)):
        live = live[live + step < len(key)]
        live = live[key[live] == key[live + step]]
        if not len(live):
            break
        x = values[live] ^ values[live + step]
        shared = (x.view(np.uint8).reshape(-1, 8) == 0).sum(1)
        hit = live[shared >= least]
        hit = hit[np.bitwise_count(values[hit] ^ values[hit + step]) <= bits]
        a_out.append(values[hit])
        b_out.append(values[hit + step])
    return np.concatenate(a_out), np.concatenate(b_out)


def neighbours_within(values: np.ndarray, mask: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among entries that share all bytes of ``mask``, by looking up every flip of up to ``bits`` free bits."""
    values = np.unique(values)
    if len(values) <= LONG:
        a, b = pairs_within(values, bits)
        return values[a], values[b]
    free = [b for b in range(64) if not mask >> b & 1]
    a_out, b_out = [], []
    for k in range(1, bits + 1):
        for c in combinations(free, k):
            flip = np.uint64(sum(1 << b for b in c))
            other = values ^ flip
            at = np.minimum(np.searchsorted(values, other), len(values) - 1)
            hit = (values[at] == other) & (other > values)
            a, b = forest(values[hit].view(np.int64), other[hit].view(np.int64))
            a_out.append(a)
            b_out.append(b)
        if k > 0:
            a, b = forest(np.concatenate(a_out), np.concatenate(b_out))
            a_out, b_out = [a], [b]
    return a_out[0].view(np.uint64), b_out[0].view(np.uint64)


def runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(choice, key, value) arrays whose runs of equal (choice, key) are whole, from sorted batches, about ``most`` rows at a time."""
    held: list[list[np.ndarray]] = []
    n = 0
    for batch in batches:
        held.append([batch.column(k).to_numpy() for k in range(3)])
        n += batch.num_rows
        if n >= most:
            c, k, v = (np.concatenate(x) for x in zip(*held, strict=True))
            other = np.flatnonzero((c != c[-1]) | (k != k[-1]))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield c[:cut], k[:cut], v[:cut]
            held, n = [[c[cut:], k[cut:], v[cut:]]], len(c) - cut
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))  # type: ignore[misc]


def near_pairs(entries: DataFrame, bits: int = 3, long: int = LONG, rest: bool = True) -> DataFrame:
    """(a, b): links that connect the distinct fingerprints in ``entries.bits`` as all pairs within ``bits`` bits would.

    Without ``rest`` lists of over ``long`` entries are left out, for callers that find what is in them in another way.
    """
    n = entries.count()
    level = level_for(n, bits)

    def posted(df: DataFrame, level: int) -> DataFrame:
        keys = [F.col("bits").bitwiseAND(F.lit(m if m < 1 << 63 else m - (1 << 64))) for m in masks(level, bits)]
        return df.select(F.posexplode(F.array(*keys)).alias("choice", "key"), "bits")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, k, v in runs(batches, 1 << 18):
            new = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (k[1:] != k[:-1])])
            size = np.diff(np.append(new, len(c)))
            run = np.repeat(np.arange(len(new)), size)
            v = v.view(np.uint64)
            short = size[run] <= 16
            links = [short_runs(run[short], v[short], bits)]
            for s, m in zip(new[(size > 16) & (size <= long)].tolist(), size[(size > 16) & (size <= long)].tolist()):
                a, b = pairs_within(v[s : s + m], bits)
                links.append((v[s : s + m][a], v[s : s + m][b]))
            a, b = forest(*(np.concatenate(x).view(np.int64) for x in zip(*links, strict=True)))
            over = v[size[run] > long].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, over])), pa.array(np.concatenate([b, over]))], ["a", "b"])

    def link_long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = masks(8 - bits, bits)
        for c, k, v in runs(batches, 1 << 18):
            new = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (k[1:] != k[:-1])])
            for s, e in zip(new.tolist(), np.append(new[1:], len(c)).tolist()):
                if e - s > 1:
                    a, b = neighbours_within(v[s:e].view(np.uint64), own[int(c[s])], bits)
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    dealt = posted(entries, level).repartition("choice", "key").sortWithinPartitions("choice", "key")
    found = stored(dealt.mapInArrow(link, "a long, b long"), "simhash-links")
    if not rest:
        return found.filter("a <> b")
    over = found.filter("a = b").select(F.col("a").alias("bits")).distinct()
    dealt = posted(over, 8 - bits).repartition("choice", "key").sortWithinPartitions("choice", "key")
    return found.filter("a <> b").unionByName(dealt.mapInArrow(link_long, "a long, b long"))


def near_duplicates(docs: DataFrame, words: int = 3, bits: int = 3, long: int = LONG, rest: bool = True) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row."""
    marked = stored(fingerprints(docs, words), "simhash")
    entries = stored(marked.groupBy("bits").agg(F.min("doc_id").alias("rep")), "simhash-entries")
    linked = components(near_pairs(entries.select("bits"), bits, long, rest))  # over fingerprints
    whole = entries.join(linked, entries["bits"] == linked["node"], "left").withColumn("group", F.coalesce("root", "bits"))
    least = whole.groupBy("group").agg(F.min("rep").alias("component_id"))
    of = whole.join(least, "group").select(F.col("bits").alias("e_bits"), "component_id")
    return marked.join(of, F.col("bits") == F.col("e_bits"), "left").select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` whose document is its component's smallest; a null doc_id keeps its row.

    The rows of one id are one document: equal rows stay or go together, and all go if any of their texts is a near copy of a
    smaller id's. nearcopies.deduplicated tells rows of one id apart and is what the pipeline uses.
    """
    groups = near_duplicates(docs, **how).filter("doc_id <> component_id").select(F.col("doc_id").alias("_dup_id")).distinct()
    return docs.join(groups, F.col("doc_id") == F.col("_dup_id"), "left_anti")


