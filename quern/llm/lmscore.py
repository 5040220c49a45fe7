"""LM scoring: subword lattice likelihood.

A word's lattice holds every way to cut it into pieces of an existing vocabulary; a forward pass in log
space sums the weights of all of them. Pieces start from the vocabulary's own scores (its merge order, read as
ranks of a Zipf law) and are weighted anew by expected counts over all words of the training documents, in
some rounds together and then once by class, with the first weights as a prior. A character outside the vocabulary is spelt
by its byte pieces. Words begin with the mark that begins pieces too, so the weights of all words sum to one.

Beside the cuts into pieces a word's lattice has one arc for the whole word if training has it, by absolute
discounting: P0(t) = max(c - d, 0) / N + d V / N * B(t), where B is ``END`` for the end and the pieces'
probability of a word, scaled, for words. A document is of one of a few classes, the ``CLASSES`` most frequent
languages of the training documents and the rest: a class has its own piece weights in B and its own counts,
discounted in the same way towards P0. A document's words are drawn from an urn: the i-th word is w with probability
(s P(w) + the number of w before it) / (s + i - 1), as documents repeat their own words; the urn's strength s is one of
``STRENGTHS`` or endless. A document's probability is the sum over the classes and strengths of their shares times
the product over the document's words and its end, so its own class is never read.

1. Documents are read once, in units of some megabytes: a unit numbers its distinct words, a document is the
   numbers and counts of its words, and the unit's dictionary has the words' training counts.
2. The dictionaries are summed by word: each distinct word of the corpus is counted and scored once.
3. Scores go back to the units' dictionaries, and each unit sums up its documents.

Defined results: null text is empty and has the end alone; without training documents N is 0, every base
term is 0 and P is B; words of any length are scored whole; rows of one id each give a row; a null id counts as an
empty text in the hash; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import itertools
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.sampling import held_out
from quern.llm.shared import stored

MARK, END, ZIPF, PRIOR, LOG10 = "▁", 0.01, 2.7, 2000.0, math.log(10)
#: Bytes of text in one unit, about, and rounds of the shared weights before those of the classes.
UNIT, ROUNDS = 24_000_000, 3
#: Languages with a class of their own, at most.
CLASSES = 4
#: How many words a document's urn starts from, beside endless ones: powers of eight, so that nothing is chosen by results.
STRENGTHS = tuple(8.0**k for k in range(1, 5))
#: Words of documents that are summed up at once, about.
TOGETHER = 1 << 15
NEVER = -math.inf


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@functools.lru_cache(maxsize=2)
def vocabulary_weights(path: str) -> tuple[tuple[str, ...], tuple[float, ...], tuple[float, ...]]:
    """Pieces with their log probabilities, and those of the 256 bytes, from the vocabulary's scores."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, weights = [], []
    for i in range(sp.get_piece_size()):
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) and sp.get_score(i) > -1e8:
            p = sp.id_to_piece(i)
            if MARK not in p[1:] and not any("A" <= c <= "Z" for c in p):
                pieces.append(p)
                weights.append(1 / (ZIPF - sp.get_score(i)))
    least = min(weights)
    total = sum(weights) + 256 * least
    return tuple(pieces), tuple(math.log(w / total) for w in weights), tuple([math.log(least / total)] * 256)


@functools.lru_cache(maxsize=4)
def automaton(pieces: tuple[str, ...]):
    """Finds every piece in a text; a worker builds it once for all its tasks and classes."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for i, p in enumerate(pieces):
        found.add_word(p, i)
    found.make_automaton()
    return found


class Lattice:
    """Pieces, and a row of log weights of pieces and bytes for each class."""

    def __init__(self, pieces: tuple[str, ...], logs: list[float] | np.ndarray, byte_logs: list[float] | np.ndarray):
        self.pieces = tuple(pieces)
        self.weights = np.concatenate([np.atleast_2d(logs), np.atleast_2d(byte_logs)], axis=1).astype(float)
        self.lengths = np.array([len(p) for p in self.pieces], np.int64)
        self.letters = {p for p in self.pieces if len(p) == 1}
        self.found = automaton(self.pieces)

    def forward(self, word: str) -> float:
        """The natural log of the summed weights of all cuts of ``word``, in the first class."""
        return float(self.forwards([word])[0, 0])

    def forwards(self, words: list[str]) -> np.ndarray:
        """The same for every word (rows) and class (columns)."""
        out = np.zeros((len(words), len(self.weights)))
        for a, b in batches_of(words):
            arcs = Arcs(self, words[a:b])
            out[a:b] = arcs.swept(arcs.heads, arcs.first, arcs.last, arcs.last - arcs.heads[arcs.owner])[:, arcs.tails].T
        return out


class Arcs:
    """The arcs of some words' lattices.

    A word of n characters with its mark has n + 1 nodes, those of all words stand in one row (``heads`` and
    ``tails`` are the outer ones). A character outside the vocabulary has an arc of its own, with the number
    len(pieces) + 256 + k, ``spelt[k]`` being its bytes.
    """

    def __init__(self, lattice: Lattice, words: list[str]):
        marked = [MARK + w for w in words]
        text = "".join(marked)  # pieces have no mark but in front, so none spans two words
        sizes = np.fromiter(map(len, marked), np.int64, len(marked))
        ends = np.cumsum(sizes)
        self.heads, self.tails = ends - sizes + np.arange(len(words)), ends + np.arange(len(words))
        pairs = list(lattice.found.iter(text))
        flat = np.fromiter(itertools.chain.from_iterable(pairs), np.int64, 2 * len(pairs)).reshape(-1, 2)
        at, self.piece, lengths = flat[:, 0], flat[:, 1], lattice.lengths[flat[:, 1]]
        self.spelt, self.weights = [], lattice.weights
        if odd := sorted(set(text) - lattice.letters):
            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
            known = np.array([ord(c) for c in odd], np.uint32)
            spots = np.flatnonzero(np.isin(codes, known))
            n = len(lattice.pieces)
            self.spelt = [list(c.encode("utf-8", "surrogatepass")) for c in odd]
            self.weights = np.concatenate([self.weights, np.stack([self.weights[:, [n + x for x in c]].sum(axis=1) for c in self.spelt], axis=1)], axis=1)
            self.piece = np.concatenate([self.piece, n + 256 + np.searchsorted(known, codes[spots])])
            at, lengths = np.concatenate([at, spots]), np.concatenate([lengths, np.ones(len(spots), np.int64)])
        self.owner = np.searchsorted(ends, at, side="right")
        self.last = at + 1 + self.owner
        self.first = self.last - lengths

    def swept(self, roots: np.ndarray, source: np.ndarray, target: np.ndarray, level: np.ndarray) -> np.ndarray:
        """By class and node, the log of the summed weights of all ways from the node's word's root.

        ``level`` is the target's distance from it: targets of one level are summed at once, in log space, as
        their sources are of lower ones.
        """
        at = np.full((len(self.weights), int(self.tails[-1]) + 1 if len(self.tails) else 0), NEVER)
        at[:, roots] = 0.0
        order = np.argsort(level * (at.shape[1] + 1) + target, kind="stable")
        source, target, level = source[order], target[order], level[order]
        weights = self.weights[:, self.piece[order]]
        opens = np.flatnonzero(np.diff(target, prepend=-1))  # an arc that is its target's first
        groups = np.searchsorted(opens, np.flatnonzero(np.diff(level, prepend=-1)))  # a target that is its level's first
        bounds = [*groups.tolist(), len(opens)]
        edges = np.append(opens, len(target))
        for g, h in itertools.pairwise(bounds):
            a, b = edges[g], edges[h]
            x, starts = at[:, source[a:b]] + weights[:, a:b], opens[g:h] - a
            top = np.maximum.reduceat(x, starts, axis=1)
            top[top == NEVER] = 0.0
            x -= np.repeat(top, np.diff(edges[g : h + 1]), axis=1)
            with np.errstate(divide="ignore"):
                at[:, target[opens[g:h]]] = top + np.log(np.add.reduceat(np.exp(x), starts, axis=1))
        return at


def batches_of(words: list[str], most: int = 60_000) -> Iterator[tuple[int, int]]:
    """Ranges of words of about ``most`` characters together."""
    a = size = 0
    for i, w in enumerate(words):
        if size and size + len(w) > most:
            yield a, i
            a, size = i, 0
        size += len(w) + 1
    if a < len(words):
        yield a, len(words)


def expect(lattice: Lattice, words: list[str], weights: np.ndarray) -> np.ndarray:
    """Expected uses of every piece and byte (rows) over ``words``, for each column of ``weights``, a row for each word."""
    n = len(lattice.pieces)
    total = np.zeros((n + 256, weights.shape[1]))
    for a, b in batches_of(words):
        arcs = Arcs(lattice, words[a:b])
        at = arcs.swept(arcs.heads, arcs.first, arcs.last, arcs.last - arcs.heads[arcs.owner])[0]
        back = arcs.swept(arcs.tails, arcs.last, arcs.first, arcs.tails[arcs.owner] - arcs.first)[0]
        x = at[arcs.first] + arcs.weights[0, arcs.piece] + back[arcs.last] - at[arcs.tails[arcs.owner]]
        uses = np.exp(np.where(x > -30, x, NEVER))
        for k in range(weights.shape[1]):
            got = np.bincount(arcs.piece, uses * weights[a:b][arcs.owner, k], n + 256 + len(arcs.spelt))
            total[:, k] += got[: n + 256]
            for c, spelt in zip(got[n + 256 :].tolist(), arcs.spelt, strict=True):
                np.add.at(total[:, k], n + np.array(spelt), c)
    return total


def reweighted(base: Lattice, counts: np.ndarray) -> Lattice:
    """The lattice of expected uses, a class for each column of ``counts``, with the weights of ``base``'s first class as ``PRIOR`` uses."""
    counts = counts.T + PRIOR * np.exp(base.weights[0])
    new = np.log(counts / counts.sum(axis=1, keepdims=True))
    n = len(base.pieces)
    return Lattice(base.pieces, new[:, :n], new[:, n:])


def packed(ids: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Ascending numbers as 16-bit steps, and their counts as bytes. A longer step is taken in several with count 0, a larger count is split."""
    step = np.diff(ids, prepend=0)
    far, many = step // 65535, np.maximum(-(-counts // 255), 1)
    n = far + many
    last = np.cumsum(n)
    steps, parts = np.zeros(last[-1] if len(n) else 0, np.int64), np.zeros(last[-1] if len(n) else 0, np.int64)
    for k in np.flatnonzero(far).tolist():
        steps[last[k] - n[k] : last[k] - n[k] + far[k]] = 65535
    at = last - many
    steps[at] = step - 65535 * far
    spots = np.repeat(at, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    parts[spots] = 255
    parts[last - 1] = counts - 255 * (many - 1)
    return steps.astype("<u2").tobytes(), parts.astype(np.uint8).tobytes()


def unpacked(steps: bytes, parts: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(np.frombuffer(steps, "<u2").astype(np.int64)), np.frombuffer(parts, np.uint8).astype(np.int64)


def log_rising(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The log of x (x + 1) ... (x + n - 1), by Stirling's series from x + 8 on."""

    def log_gamma(z: np.ndarray) -> np.ndarray:
        low, z = functools.reduce(np.multiply, [z + j for j in range(8)]), z + 8
        return (z - 0.5) * np.log(z) - z + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - np.log(low)

    return log_gamma(x + n) - log_gamma(x)


def urns(logs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """By strength (rows) and class, what urns_of() gives for one document."""
    return urns_of(logs, counts, np.array([0, len(counts)]))[:, 0]


def urns_of(logs: np.ndarray, counts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """By strength, document and class, the log probability of a document's words, the strengths being equally likely.

    Rows of ``logs`` are words' log probabilities by class, drawn ``counts`` times; those of document d go from ``starts[d]`` to ``starts[d + 1]``.
    """
    of = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    once, more = counts < 2, counts > 1
    total, ones = added(counts[:, None], of, starts), added(counts[once, None], of[once], starts)
    out = [added(counts[:, None] * logs, of, starts)]
    single, odds = added(counts[once, None] * logs[once], of[once], starts), np.exp(logs[more])
    for strength in STRENGTHS:
        drawn = single + math.log(strength) * ones + added(log_rising(strength * odds, counts[more, None]), of[more], starts)
        out.append(drawn - log_rising(np.float64(strength), total))
    return np.stack(out) - math.log(len(out))


def added(values: np.ndarray, of: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of rows by document, ``of`` ascending; documents without a row have zeros."""
    out = np.zeros((len(starts) - 1, values.shape[1]))
    first = np.flatnonzero(np.diff(of, prepend=-1))
    if len(first):
        out[of[first]] = np.add.reduceat(values, first, axis=0)
    return out


def several(steps: list[bytes], parts: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """What unpacked() gives for documents a to b, and where each one's starts, about ``TOGETHER`` words at a time."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends, a = np.cumsum(sizes), 0
    while a < len(parts):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] - sizes[a] + TOGETHER, "right")))
        starts = np.concatenate([[0], np.cumsum(sizes[a:b])])
        numbers, counts = unpacked(b"".join(steps[a:b]), b"".join(parts[a:b]))
        before = np.concatenate([[0], numbers])[starts[:-1]]
        yield a, b, numbers - np.repeat(before, sizes[a:b]), counts, starts
        a = b


def units(docs: DataFrame, unit: int) -> DataFrame:
    """Documents as numbers and counts of their unit's words, and the units' dictionaries, in one table.

    A unit's documents are all of one class (``kind``; -1: held out), so a dictionary's counts are its class's.
    """
    schema = "unit long, doc_id {}, held_out boolean, kind int, n long, numbers binary, counts binary, word binary, number int".format(docs.schema["doc_id"].dataType.simpleString())
    names = ["unit", "doc_id", "held_out", "kind", "n", "numbers", "counts", "word", "number"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[int, dict] = {}
        id_type = None

        def dictionary(kind: int) -> pa.RecordBatch:
            state = open_.pop(kind)
            k = len(state["numbers"])
            train = np.zeros(k, np.int64)
            for ids, counts in state["train"]:
                train[ids] += counts
            none = lambda t: pa.nulls(k, t)
            return pa.RecordBatch.from_arrays([pa.array(np.full(k, state["unit"])), none(id_type), none(pa.bool_()), pa.array(np.full(k, kind, np.int32)), pa.array(train), none(pa.binary()), none(pa.binary()), pa.array(list(state["numbers"]), pa.binary()), pa.array(np.arange(k, dtype=np.int32))], names)

        for batch in batches:
            id_type = batch.column(0).type
            texts, kinds = batch.column(1).cast(pa.binary()).to_pylist(), batch.column(3).to_numpy()
            for kind in np.unique(kinds).tolist():
                at = np.flatnonzero(kinds == kind)
                rows: list[tuple] = []
                a = 0
                for j, i in enumerate(at.tolist()):
                    state = open_.setdefault(kind, {"unit": uuid.uuid4().int >> 65, "numbers": {}, "size": 0, "train": []})
                    t = texts[i] or b""
                    words, numbers = t.lower().split(), state["numbers"]
                    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
                    ids, counts = np.unique(ids, return_counts=True)
                    if kind >= 0:
                        state["train"].append((ids, counts))
                    rows.append((len(words), *packed(ids, counts)))
                    state["size"] += len(t)
                    full = state["size"] >= unit
                    if full or j + 1 == len(at):
                        own, k = pa.array(at[a : j + 1]), j + 1 - a
                        n, ids_, counts_ = zip(*rows, strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(k, state["unit"])), batch.column(0).take(own), batch.column(2).take(own), pa.array(np.full(k, kind, np.int32)), pa.array(n, pa.int64()), pa.array(ids_, pa.binary()), pa.array(counts_, pa.binary()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.int32())], names)
                        a, rows = j + 1, []
                    if full:
                        yield dictionary(kind)
        for kind in list(open_):
            yield dictionary(kind)

    return docs.mapInArrow(run, schema)


def fit(words: DataFrame, kinds: int, vocabulary: str) -> Lattice:
    """Each class's piece weights, from all distinct training words in ``words``: a class's words count once in it. The last row is of all words."""
    first = Lattice(*vocabulary_weights(vocabulary))
    names, size = first.pieces, len(first.pieces) + 256
    train = words.filter("c > 0").select("word", *[f"c{k}" for k in range(kinds)])

    def expected(weights: np.ndarray, classes: int) -> np.ndarray:
        """Expected uses of the pieces over all training words (first column) and those of each class."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, total = Lattice(names, weights[:, :-256], weights[:, -256:]), np.zeros((size, classes + 1))
            for batch in batches:
                has = np.stack([np.ones(batch.num_rows), *(batch.column(1 + k).to_numpy() > 0 for k in range(classes))], axis=1)
                texts = [w.decode("utf-8", "replace") for w in batch.column(0).to_pylist()]
                total += expect(own, texts, has)
            piece, k = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(k), pa.array(total[piece, k])], ["piece", "k", "n"])

        total = np.zeros((size, classes + 1))
        uses = train.mapInArrow(run, "piece long, k long, n double").groupBy("piece", "k").agg(F.sum("n").alias("n")).toArrow()  # a row for each piece and class at most
        total[uses["piece"].to_numpy(), uses["k"].to_numpy()] = uses["n"].to_numpy()
        return total

    shared = first
    for _ in range(ROUNDS):
        shared = reweighted(first, expected(shared.weights, 0))
    total = expected(shared.weights, kinds)
    whole = reweighted(first, total[:, :1])
    weights = np.concatenate([reweighted(whole, total[:, 1:]).weights, whole.weights])
    return Lattice(names, weights[:, :-256], weights[:, -256:])


def scores(docs: DataFrame, vocabulary: str | None = None, unit: int = UNIT, classes: int = CLASSES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, lattice_score) for every row.

    ``lattice_score`` is the probability by cuts into pieces alone, without whole words, urns and classes. Scores
    have six digits, so that reruns over other partitions agree.
    """
    vocabulary = vocabulary or default_vocabulary()
    given = docs.select("doc_id", "text", held_out(F.col("doc_id"), 7).alias("held_out"), (F.col("lang") if "lang" in docs.columns else F.lit(None)).cast("string").alias("lang"))
    top = given.filter("NOT held_out AND lang IS NOT NULL").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(classes).collect()
    kind, kinds = F.lit(len(top)), len(top) + 1
    for k, r in enumerate(top):
        kind = F.when(F.col("lang") == r["lang"], k).otherwise(kind)
    given = given.select("doc_id", "text", "held_out", F.when(F.col("held_out"), -1).otherwise(kind).alias("kind"))
    parts = stored(units(given, unit), "lm-units")
    texts, dictionary = parts.filter("number IS NULL"), parts.filter("number IS NOT NULL")
    words = stored(dictionary.groupBy("word").agg(F.sum("n").alias("c"), *[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"c{k}") for k in range(kinds)]), "lm-words")
    cols = ["c", *(f"c{k}" for k in range(kinds))]
    sums = words.agg(*[F.coalesce(F.sum(x), F.lit(0)) for c in cols for x in (F.col(c), F.expr(f"int({c} > 0)"), F.expr(f"int({c} = 1)"), F.expr(f"int({c} = 2)"))]).first()
    ended = {r["kind"]: r["count"] for r in texts.filter("kind >= 0").groupBy("kind").count().collect()}
    ends = np.array([sum(ended.values()), *(ended.get(k, 0) for k in range(kinds))], float)
    n, v, n1, n2 = (np.array(sums[i::4], float) for i in range(4))
    total, distinct = n + ends, v + (ends > 0)
    off = np.clip(np.divide(n1, n1 + 2 * n2, out=np.full(len(n1), 0.5), where=n1 + n2 > 0), 0.1, 0.95)
    free = np.divide(off * distinct, total, out=np.ones(len(n)), where=total > 0)
    fitted = fit(words, kinds, vocabulary)
    names, weights = fitted.pieces, fitted.weights
    prior = np.log(np.maximum(ends[1:] / ends[0], 1e-300)) if ends[0] else np.full(kinds, -math.log(kinds))

    def p(c: np.ndarray, b: np.ndarray) -> np.ndarray:
        """log10 of each class's probability (columns) of words with counts ``c`` (whole, then by class) and pieces' log probabilities ``b``."""
        own = np.log(np.maximum(c - off, 0) / np.maximum(total, 1), where=c > off, out=np.full(c.shape, NEVER))
        wide = np.logaddexp(own[:, :1], math.log(free[0]) + b)
        return np.logaddexp(own[:, 1:], np.log(free[1:]) + wide) / LOG10

    def score_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lattice(names, weights[:, :-256], weights[:, -256:])
        for batch in batches:
            texts = [w.decode("utf-8", "replace") for w in batch.column(0).to_pylist()]
            b = own.forwards(texts) + math.log(1 - END)
            whole = p(np.stack([batch.column(1 + k).to_numpy() for k in range(kinds + 1)], axis=1).astype(float), b[:, :kinds])
            logs = np.concatenate([whole, b[:, kinds:] / LOG10], axis=1).astype("<f4")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in logs], pa.binary())], ["w", "c", "logs"])

    scored = words.select("word", *cols).mapInArrow(score_words, "w binary, c long, logs binary")
    known = dictionary.select("unit", "word", "number").join(scored, F.col("word") == F.col("w")).select("unit", "number", "c", "logs")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Many rows of one unit as one."""
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            unit = t.column(0).to_numpy()
            logs = np.frombuffer(b"".join(t.column(3).to_pylist()), "<f4").reshape(len(unit), -1)
            order = np.argsort(unit, kind="stable")
            cuts = np.flatnonzero(np.diff(unit[order])) + 1
            blobs = [[x[i].tobytes() for i in np.split(order, cuts)] for x in (t.column(1).to_numpy().astype("<i4"), t.column(2).to_numpy().astype("<i8"), logs)]
            yield pa.RecordBatch.from_arrays([pa.array(unit[order][np.r_[0, cuts]]), *(pa.array(x, pa.binary()) for x in blobs)], ["of", "number", "c", "logs"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= 1 << 17:
                yield from flush()
                held = []
        if held:
            yield from flush()

    known = known.mapInArrow(pack, "of long, number binary, c binary, logs binary")
    end_base, end_score = math.log10((ends[0] + 1) / (total[0] + distinct[0] + 1)), p(ends[None], np.full((1, kinds), math.log(END)))[0] + prior / LOG10
    not_end = np.log1p(-(10 ** (end_score - prior / LOG10)))
    n_all, size_all, any_end = int(total[0]), float(total[0] + distinct[0] + 1), int(ends[0] > 0)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def add_up(left: pa.Table, right: pa.Table) -> pa.Table:
        at, given_c, given_logs = (np.frombuffer(b"".join(right.column(x).to_pylist()), kind) for x, kind in (("number", "<i4"), ("c", "<i8"), ("logs", "<f4")))
        c, logs = np.zeros(len(at), np.int64), np.zeros((len(at), kinds + 1))
        c[at], logs[at] = given_c, given_logs.reshape(-1, kinds + 1)
        base = np.log10((c + 1) / size_all)
        known_, base_, score_, alone_ = (np.zeros(left.num_rows, x) for x in (np.int64, float, float, float))
        for a, b, i, k, starts in several(left.column("numbers").to_pylist(), left.column("counts").to_pylist()):
            of, k_ = np.repeat(np.arange(b - a), np.diff(starts)), k[:, None]
            drawn = added(k_, of, starts)
            each = urns_of(logs[i, :kinds] * LOG10 - not_end, k, starts) + drawn * not_end + end_score * LOG10
            known_[a:b] = added(k_ * (c[i, None] > 0), of, starts)[:, 0] + any_end
            base_[a:b] = added(k_ * base[i, None], of, starts)[:, 0] + end_base
            score_[a:b] = np.logaddexp.reduce(each, axis=(0, 2)) / LOG10
            alone_[a:b] = added(k_ * logs[i, kinds, None], of, starts)[:, 0] + math.log10(END)
        known_, base_, score_, alone_ = known_.tolist(), base_.tolist(), score_.round(6).tolist(), alone_.round(6).tolist()
        return pa.table([left.column("doc_id"), left.column("held_out"), pa.array(np.asarray(left.column("n").to_numpy()) + 1), pa.array(known_, pa.int64()), pa.array([n_all] * left.num_rows, pa.int64()), pa.array(base_, pa.float64()), pa.array(score_, pa.float64()), pa.array(alone_, pa.float64())], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "lattice_score"])

    return texts.select("unit", "doc_id", "held_out", "n", "numbers", "counts").groupBy("unit").cogroup(known.groupBy("of")).applyInArrow(add_up, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, lattice_score double")
