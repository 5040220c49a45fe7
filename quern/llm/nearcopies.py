"""Near copies by SimHash fingerprints, verified and completed by the Jaccard similarity of five-word shingles.

Two documents are linked if their sets of shingles have a similarity of 4/5 or more. Most such pairs are found by the
method of simhash.py at five bits: fingerprints are entered under positional bytes, shared bytes are tallied, pairs are checked
bit by bit, and each text is verified with the first one of its group. Texts that fingerprints leave apart, those of its
longest lists too, are met by an exact prefix filter, so nothing is missed for want of a candidate. For it, shingles of a document are put in one global order, and only the first
``n - ceil(4 n / 5) + 1`` of its ``n`` are posted: two similar documents share one of those
(prefix filtering). The places of a shared shingle bound what the two can share at all, and
pairs below the bound go. So do those whose maps (a bit for each hash value, flipped by every shingle that has it) differ
in more bits than similar sets have shingles apart. A map is as wide as its set asks for, so that it tells long texts apart too. The
others are verified on their whole texts.

The order is by hash, with shingles that many sampled documents have put last; the sample only decides
how much work there is, never what is found. Equal texts are one entry. In a list of over ``SHORT``
entries each is first paired with one of them, and only pairs that the links so far leave in different
groups are made after that, in one task where it can hold their sets; so groups are as all pairs would give them.

Defined results: words are lower-cased in ASCII and parted at ASCII white space; fewer words than a
shingle are one shingle; texts without a word are copies of one another; shingles are told apart by
64-bit hashes; a null doc_id keeps its row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.components import components, forest
from quern.llm.shared import batches_of, dropped, stored, swept
from quern.llm.simhash import _texts, near_duplicates

WORDS = 5
#: Bits at which fingerprints lead to one another: five leave three shared bytes, which is a short list.
BITS = 5
#: Entries of a posting list that are paired up at once, at most.
SHORT = 16
#: Documents in the sample of common shingles, the least of them that make a shingle common, and how many such are kept.
SAMPLE, COMMON, KEPT = 20_000, 8, 50_000
#: Shingles of a list that one task holds, at most, and the pairs for each entry from which on it does.
HELD, MANY = 4_000_000, 1
#: Pairs whose maps are compared at a time, in 64-bit words of them.
WORDS_AT_ONCE = 1 << 21
#: Signatures that are broadcast to pick the texts of pairs, at most.
PICKED = 1_000_000

_TIMES = np.random.default_rng(5).integers(0, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PAIRS, ENTRIES = "a long, b long", "sig long, size int, place int, key long"


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def signature(text: bytes | None) -> int:
    """Equal for texts of equal words, as a signed 64-bit integer."""
    from xxhash import xxh64_intdigest

    h = xxh64_intdigest(b" ".join((text or b"").lower().split()), 7)
    return h - (1 << 64) if h >> 63 else h


def shingles(text: bytes | None) -> np.ndarray:
    """The distinct shingles' hashes in ascending order."""
    from xxhash import xxh64_intdigest

    w = (text or b"").lower().split()
    if len(w) < WORDS:
        return np.array([xxh64_intdigest(b" ".join(w), 9)] if w else [], np.uint64)
    h = np.array([xxh64_intdigest(x, 3) for x in w], np.uint64)
    n = len(w) - WORDS + 1
    total = np.zeros(n, np.uint64)
    for i in range(WORDS):
        total += h[i : i + n] * _TIMES[i]
    return np.unique(mixed(total))


def prefix(h: np.ndarray, common: np.ndarray) -> np.ndarray:
    """What is posted of a set: its first shingles in the global order."""
    if len(common):
        last = common[np.minimum(np.searchsorted(common, h), len(common) - 1)] == h
        h = np.concatenate([h[~last], h[last]])
    return h[: len(h) - -(-4 * len(h) // 5) + 1]


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 9 * both >= 4 * (len(a) + len(b))


def may(size_a, place_a, size_b, place_b) -> np.ndarray:
    """Whether sets that share the shingle at these places can share enough."""
    most = np.minimum(place_a, place_b) + 1 + np.minimum(size_a - 1 - place_a, size_b - 1 - place_b)
    return 9 * most >= 4 * (size_a + size_b)


def flips(h: np.ndarray) -> bytes:
    """A set's map, of a power of two of bits, twice its shingles at least: two maps differ in as many bits as their sets have shingles apart, at most."""
    bits = 1 << max(6, (2 * len(h) - 1).bit_length())
    return np.packbits((np.bincount((h % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def close(size: np.ndarray, maps: list[bytes], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the sets at a and b may be similar by their sizes and maps; the wider one of two is folded, which keeps every shingle's flip."""
    width = np.array([len(m) // 8 for m in maps], np.int64)
    row, held = np.zeros(len(maps), np.int64), {}
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        row[at] = np.arange(len(at))
        held[w] = np.frombuffer(b"".join([maps[i] for i in at.tolist()]), np.uint64).reshape(-1, w)
    out = np.zeros(len(a), bool)
    alike = np.flatnonzero(5 * np.minimum(size[a], size[b]).astype(np.int64) >= 4 * np.maximum(size[a], size[b]).astype(np.int64))
    kinds, of = np.unique(np.stack([width[a[alike]], width[b[alike]]], 1), axis=0, return_inverse=True)
    for k, (x, y) in enumerate(kinds.tolist()):
        pairs = alike[of.ravel() == k]
        step, w = max(1, WORDS_AT_ONCE // max(x, y)), min(x, y)
        for some in (pairs[i : i + step] for i in range(0, len(pairs), step)):
            m, n = (np.bitwise_xor.reduce(held[v][row[e[some]]].reshape(len(some), -1, w), axis=1) for v, e in ((x, a), (y, b)))
            # sets of a and b are similar if 9 times what they have apart is at most their sizes' sum
            out[some] = 9 * np.bitwise_count(m ^ n).sum(axis=1, dtype=np.int64) <= size[a[some]].astype(np.int64) + size[b[some]]
    return out


def bodies(column: pa.Array, step: int = 256) -> Iterator[bytes | None]:
    """Texts as bytes, few of them at a time."""
    for i in range(0, len(column), step):
        yield from _texts(column.slice(i, step))


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, row, sig) for every row: ``row`` is a hash of its text, which tells rows of one id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([signature(t) for t in bodies(batch.column(2))], pa.int64())], ["doc_id", "row", "sig"])

    return docs.select("doc_id", F.xxhash64("text").alias("row"), "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, row long, sig long")


def common_shingles(texts: DataFrame, n: int) -> np.ndarray:
    """Shingles of many sampled texts (sig, text), ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in bodies(batch.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t).view(np.int64))], ["key"])

    share = max(1, n // SAMPLE)
    some = texts.filter(F.pmod(F.xxhash64("sig"), F.lit(share)) == 0).select("sig", "text").mapInArrow(run, "key long")
    rows = some.groupBy("key").count().filter(F.col("count") >= COMMON).orderBy(F.desc("count"), "key").limit(KEPT).select("key")
    with swept(texts.sparkSession):
        rows = rows.toArrow()
    return np.sort(rows.column(0).to_numpy().view(np.uint64))


def posted(texts: DataFrame, common: np.ndarray) -> DataFrame:
    """(sig, size, place, key): the prefix of each text of (sig, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs, out, n = batch.column(0).to_pylist(), [], 0
            for i, (sig, t) in enumerate(zip(sigs, bodies(batch.column(1)), strict=True)):
                h = shingles(t)
                keys = prefix(h, common) if len(h) else h
                out.append((sig, len(h), keys))
                n += len(keys)
                if n and (n > 1 << 16 or i + 1 == len(sigs)):
                    m = [len(k) for _, _, k in out]
                    columns = [np.repeat(np.array([x[0] for x in out], np.int64), m), np.repeat(np.array([x[1] for x in out], np.int32), m), np.concatenate([np.arange(k, dtype=np.int32) for k in m]), np.concatenate([x[2] for x in out]).view(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["sig", "size", "place", "key"])
                    out, n = [], 0

    return texts.select("sig", "text").mapInArrow(run, ENTRIES)


def whole_runs(batches: Iterator[pa.RecordBatch], key: int, most: int = 1 << 18) -> Iterator[list[np.ndarray]]:
    """Columns whose runs of equal ``key`` column are whole, from sorted batches."""
    held: list[list[np.ndarray]] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([c.to_numpy() for c in batch.columns])
        n += batch.num_rows
        if n >= most:
            cols = [np.concatenate(x) for x in zip(*held, strict=True)]
            cut = int(np.searchsorted(cols[key], cols[key][-1]))
            if cut:
                yield [c[:cut] for c in cols]
            held, n = [[c[cut:] for c in cols]], len(cols[key]) - cut
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def within(key: np.ndarray, sig: np.ndarray, size: np.ndarray, place: np.ndarray, label: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs within runs of equal key that may be similar and, given labels, differ in them."""
    live = np.arange(len(key))
    for step in range(1, len(key)):
        live = live[live + step < len(key)]
        live = live[key[live] == key[live + step]]
        if not len(live):
            return
        to = live + step
        ok = (sig[live] != sig[to]) & may(size[live], place[live], size[to], place[to])
        if label is not None:
            ok &= label[live] != label[to]
        yield sig[live[ok]], sig[to[ok]]


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
    return both[:, 0], both[:, 1]


def first_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of short lists, those of longer ones with one of their entries, and the longer lists' entries (with a key)."""
    for sig, size, place, key in whole_runs(batches, 3):
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        length = np.diff(np.append(new, len(key)))
        run = np.repeat(np.arange(len(new)), length)
        short = (length[run] > 1) & (length[run] <= SHORT)
        made = [(np.zeros(0, np.int64),) * 2, *within(key[short], sig[short], size[short], place[short])]
        long = np.flatnonzero(length[run] > SHORT)
        if len(long):
            by = np.lexsort((mixed(sig[long].view(np.uint64) ^ key[long].view(np.uint64)), run[long]))
            lead = long[by][np.flatnonzero(np.r_[True, np.diff(run[long][by]) != 0])]
            at = lead[np.searchsorted(run[lead], run[long])]
            ok = (sig[at] != sig[long]) & may(size[at], place[at], size[long], place[long])
            made.append((sig[at[ok]], sig[long[ok]]))
        a, b = _distinct(*(np.concatenate(x) for x in zip(*made, strict=True)))
        none = np.zeros(len(a), np.int32)
        columns = [np.concatenate(x) for x in ((a, sig[long]), (b, key[long]), (none, size[long]), (none, place[long]))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", "size", "place"])


def later_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of long lists whose ends have different labels, a bounded number at a time."""
    for sig, size, place, key, label in whole_runs(batches, 3):
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        run = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(key))))
        mixed_run = np.minimum.reduceat(label, new) != np.maximum.reduceat(label, new)
        on = mixed_run[run]
        held, n = [], 0
        for a, b in within(key[on], sig[on], size[on], place[on], label[on]):
            held.append((a, b))
            n += len(a)
            if n > 1 << 20:
                a, b = _distinct(*(np.concatenate(x) for x in zip(*held, strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
                held, n = [], 0
        if n:
            a, b = _distinct(*(np.concatenate(x) for x in zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def links_of_list(sig: np.ndarray, label: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Links between similar entries of different labels, enough to connect them.

    Of two labels one at least is not the most frequent one, so only entries without that one are asked for.
    """
    names, of, many = np.unique(label, return_inverse=True, return_counts=True)
    size = np.array([len(x) for x in sets], np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    out = [(np.zeros(0, np.int64),) * 2]
    for u in np.flatnonzero(of != many.argmax()).tolist():
        low, high = np.searchsorted(flat, sets[u], "left"), np.searchsorted(flat, sets[u], "right")
        n = high - low
        at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=len(sets))
        hit = np.flatnonzero((9 * both >= 4 * (size[u] + size)) & (of != of[u]))
        hit = hit[np.unique(of[hit], return_index=True)[1]]  # one of each label
        out.append((np.full(len(hit), sig[u]), sig[hit]))
    return forest(*(np.concatenate(x) for x in zip(*out, strict=True)))


def close_groups(sig: np.ndarray, size: np.ndarray, place: np.ndarray, label: np.ndarray, maps: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(entry, group) of a list's entries that may be similar to one of another label: pairs that may be similar are in one group."""
    order = np.argsort(size, kind="stable")
    names, of, many = np.unique(label, return_inverse=True, return_counts=True)
    least = size[order]
    asked = order[of[order] != many.argmax()]  # as in links_of_list
    low, high = np.searchsorted(5 * least, 4 * size[asked], "left"), np.searchsorted(4 * least, 5 * size[asked], "right")
    links = (np.zeros(0, np.int64),) * 2
    done, i = np.concatenate([[0], np.cumsum(high - low)]), 0
    while i < len(asked):
        j = max(i + 1, int(np.searchsorted(done, done[i] + WORDS_AT_ONCE, "right")) - 1)
        n = high[i:j] - low[i:j]
        a = np.repeat(asked[i:j], n)
        b = order[np.repeat(low[i:j] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        some = (of[a] != of[b]) & may(size[a], place[a], size[b], place[b])
        a, b = a[some], b[some]
        some = close(size, maps, a, b)
        links = forest(np.concatenate([links[0], a[some]]), np.concatenate([links[1], b[some]]))
        i = j
    roots = np.unique(links[1])
    return np.concatenate([links[0], roots]), np.concatenate([links[1], roots])


def close_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, sig, label): what of lists must be told by whole texts, with a new key for each group, which is that of its entries in any list."""
    held: list[pa.RecordBatch] = []

    def told() -> Iterator[pa.RecordBatch]:
        cut = pa.Table.from_batches(held)
        sig, size, place, label = (cut.column(c).to_numpy() for c in range(1, 5))
        at, group = close_groups(sig, size.astype(np.int64), place.astype(np.int64), label, cut.column(5).to_pylist())
        if not len(at):
            return
        names, of = np.unique(group, return_inverse=True)
        keys = np.zeros(len(names), np.uint64)
        np.add.at(keys, of, mixed(mixed(sig[at].view(np.uint64)) ^ label[at].view(np.uint64)))
        yield pa.RecordBatch.from_arrays([pa.array(keys[of].view(np.int64)), pa.array(sig[at]), pa.array(label[at])], ["key", "sig", "label"])

    for batch in batches:
        key = batch.column(0).to_numpy()
        new = [*np.flatnonzero(np.diff(key)) + 1, len(key)] if len(key) else []
        start = 0
        for end in map(int, new):
            if held and held[-1].column(0)[0].as_py() != int(key[start]):
                yield from told()
                held = []
            held.append(batch.slice(start, end - start))
            start = end
    if held:
        yield from told()


def verified_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of whole lists, from batches of (key, sig, label, text) sorted by key."""
    held: list[tuple[int, int, np.ndarray]] = []
    key = None

    def told() -> pa.RecordBatch:
        a, b = links_of_list(np.array([x[0] for x in held], np.int64), np.array([x[1] for x in held], np.int64), [x[2] for x in held]) if held else (np.zeros(0, np.int64),) * 2
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        for k, sig, label, text in zip(*(batch.column(c).to_pylist() for c in range(3)), bodies(batch.column(3)), strict=True):
            if k != key:
                yield told()
                held, key = [], k
            held.append((sig, label, shingles(text)))
    yield told()


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose texts are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep, last, own = [], None, None
            for i, (x, y) in enumerate(zip(bodies(batch.column(2)), bodies(batch.column(3)), strict=True)):
                if a[i] != last:
                    last, own = a[i], shingles(x)
                keep.append(similar(own, shingles(y)))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(a, np.int64)[keep]), pa.array(np.array(b, np.int64)[keep])], ["a", "b"])

    own = pairs.select(F.explode(F.array("a", "b")).alias("p_sig")).distinct()
    if own.limit(PICKED + 1).count() <= PICKED:  # only texts of pairs are dealt out
        texts = texts.join(F.broadcast(own), F.col("sig") == F.col("p_sig"), "left_semi")
    first, second = (texts.select(F.col("sig").alias(f"{x}_sig"), F.col("text").alias(f"{x}_text")) for x in "ab")
    both = pairs.join(first, F.col("a") == F.col("a_sig")).join(second, F.col("b") == F.col("b_sig"))
    return both.select("a", "b", "a_text", "b_text").mapInArrow(run, PAIRS)


def maps(texts: DataFrame) -> DataFrame:
    """(m_sig, size, map) of each text of (sig, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [(len(h), flips(h)) for h in map(shingles, bodies(batch.column(1)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in sets], pa.int32()), pa.array([m for _, m in sets], pa.binary())], ["m_sig", "size", "map"])

    return texts.select("sig", "text").mapInArrow(run, "m_sig long, size int, map binary")


def possible(pairs: DataFrame, mapped: DataFrame) -> DataFrame:
    """The pairs that by their sets' maps may be similar, which all similar ones are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            size = np.concatenate([batch.column(2).to_numpy(), batch.column(4).to_numpy()])
            keep = close(size, batch.column(3).to_pylist() + batch.column(5).to_pylist(), np.arange(n), np.arange(n, 2 * n))
            yield batch.select([0, 1]).filter(pa.array(keep))

    for x in "ab":
        pairs = pairs.join(mapped.select(F.col("m_sig").alias(f"{x}_sig"), F.col("size").alias(f"{x}_size"), F.col("map").alias(f"{x}_map")), F.col(x) == F.col(f"{x}_sig"))
    return pairs.select("a", "b", "a_size", "a_map", "b_size", "b_map").mapInArrow(run, PAIRS)


def _links(pairs: DataFrame, texts: DataFrame, mapped: DataFrame | None = None) -> DataFrame:
    if mapped is not None:
        pairs = stored(possible(pairs, mapped), "copies-possible")
    with batches_of(texts.sparkSession, 256):  # two whole texts a row
        return stored(verified(pairs, texts), "copies-links")


def fingerprint_links(texts: DataFrame) -> DataFrame:
    """(a, b): the similar pairs among those of a text and the first one that simhash's links reach from it."""
    of = near_duplicates(texts.select(F.col("sig").alias("doc_id"), "text"), bits=BITS, rest=False)
    pairs = stored(of.filter("doc_id <> component_id").select(F.col("component_id").alias("a"), F.col("doc_id").alias("b")), "copies-marked")
    return _links(pairs, texts)


def apart(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """The pairs whose ends are not in one component of ``of`` (node, root)."""
    for x in "ab":
        pairs = pairs.join(of.select(F.col("node").alias(f"{x}_node"), F.col("root").alias(f"{x}_root")), F.col(x) == F.col(f"{x}_node"), "left")
    return pairs.filter(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b")


def linked(texts: DataFrame, n: int, held: int = HELD, many_pairs: int = MANY) -> DataFrame:
    """(a, b): links that connect the signatures of ``texts`` (sig, text) as all similar pairs would."""
    links = fingerprint_links(texts)
    mapped = stored(maps(texts), "copies-maps")
    entries = posted(texts, common_shingles(texts, n))
    found = stored(entries.repartition("key").sortWithinPartitions("key").mapInArrow(first_pairs, "a long, b long, size int, place int"), "copies-found")
    first = stored(apart(found.filter("size = 0").select("a", "b").distinct(), components(links)), "copies-first")
    links = links.unionByName(_links(first, texts, mapped))
    long = found.filter("size > 0").select(F.col("a").alias("sig"), "size", "place", F.col("b").alias("key"))
    if long.isEmpty():
        return links
    of = components(links)
    labelled = stored(long.join(of, F.col("sig") == F.col("node"), "left").select("sig", "size", "place", "key", F.coalesce("root", "sig").alias("label")), "copies-long")
    by_label = labelled.groupBy("key", "label").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"))
    mixed_ = by_label.groupBy(F.col("key").alias("m_key")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("same"), F.sum("shingles").alias("shingles"), F.count("*").alias("labels"))
    many = (F.col("n") * F.col("n") - F.col("same")) / 2 > many_pairs * F.col("n")
    mixed_ = stored(mixed_.filter("labels > 1").select("m_key", (many & (F.col("shingles") <= held)).alias("fits")), "copies-mixed")
    rows = labelled.join(mixed_, F.col("key") == F.col("m_key"))
    # lists of many pairs whose sets a task can hold are narrowed in it by maps to groups that may be similar, and those are verified
    # in one task each; entries of other lists are paired up and verified pair by pair
    own = rows.filter("fits").select("key", "sig", F.col("size").alias("n"), "place", "label").join(mapped.select("m_sig", "map"), F.col("sig") == F.col("m_sig"))
    own = own.select("key", "sig", F.col("n").alias("size"), "place", "label", "map").repartition("key").sortWithinPartitions("key")
    own = stored(own.mapInArrow(close_lists, "key long, sig long, label long").distinct(), "copies-close")
    own = own.withColumnRenamed("sig", "l_sig").join(texts, F.col("l_sig") == F.col("sig")).select("key", "sig", "label", "text")
    with batches_of(texts.sparkSession, 256):
        links = links.unionByName(stored(own.repartition("key").sortWithinPartitions("key").mapInArrow(verified_lists, PAIRS), "copies-links"))
    rest = rows.filter("NOT fits").select("sig", "size", "place", "key", "label")
    if rest.isEmpty():
        return links
    more = stored(rest.repartition("key").sortWithinPartitions("key").mapInArrow(later_pairs, PAIRS).distinct(), "copies-later")
    return links.unionByName(_links(more, texts, mapped))


def _groups(docs: DataFrame, held: int, many_pairs: int = MANY) -> tuple[DataFrame, DataFrame, bool]:
    """(doc_id, row, sig) of every row; (sig, first, group) of every distinct text, ``first`` being its least (doc_id, row); whether rows repeat."""
    marked = stored(signatures(docs), "copies")
    repeated = not marked.groupBy("doc_id", "row").count().filter("count > 1").isEmpty()
    entries = stored(marked.groupBy("sig").agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "row"))).alias("first"), F.max("row").alias("any_row")), "copies-entries")
    # a text that has no id anywhere is looked up without one
    own = entries.select("sig", F.col("first.doc_id").alias("f_id"), F.coalesce("first.row", "any_row").alias("f_row"))
    texts = docs.select("doc_id", "text").join(own, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.xxhash64("text") == F.col("f_row"))).select("sig", "text")
    texts = stored(texts.dropDuplicates(["sig"]) if repeated else texts, "copies-texts")
    of = components(linked(texts, entries.count(), held, many_pairs))
    whole = entries.join(of, F.col("sig") == F.col("node"), "left").select("sig", "first", F.coalesce("root", "sig").alias("group"))
    whole = stored(whole, "copies-groups")
    dropped(texts)
    return marked, whole, repeated


def near_copies(docs: DataFrame, held: int = HELD, many_pairs: int = MANY) -> DataFrame:
    """(doc_id, component_id) for every row: the smallest doc_id of its group."""
    marked, whole, _ = _groups(docs, held, many_pairs)
    least = whole.groupBy(F.col("group").alias("g")).agg(F.min("first.doc_id").alias("component_id"))
    groups = whole.join(least, F.col("group") == F.col("g")).select(F.col("sig").alias("e_sig"), "component_id")
    return marked.join(groups, F.col("sig") == F.col("e_sig"), "left").select("doc_id", "component_id")


def deduplicated(docs: DataFrame, held: int = HELD) -> DataFrame:
    """One row of each group of ``docs``: one of the smallest doc_id in it; a row without an id stays.

    Rows are told apart by doc_id and text, so a near copy takes no other row of its id with it, and of rows equal in both one stays.
    """
    _, whole, repeated = _groups(docs, held)
    first = whole.groupBy("group").agg(F.min("first").alias("first")).filter("first IS NOT NULL").select(F.col("first.doc_id").alias("_dup_id"), F.col("first.row").alias("_dup_row"))
    kept = docs.join(first, (F.col("doc_id") == F.col("_dup_id")) & (F.xxhash64("text") == F.col("_dup_row")))
    if repeated:
        kept = kept.dropDuplicates(["_dup_id", "_dup_row"])
    names = [F.col(f"`{c}`") for c in docs.columns]
    return kept.select(*names).unionByName(docs.filter("doc_id IS NULL"))
