"""Toxicity: a convolutional text classifier over hashed word embeddings.

A word's embedding is the sum of hashed rows, of the word and of its first few bytes. Filters of several
widths slide over the words, each keeps its largest response in the document, and a logistic layer reads
those. It is trained in numpy with Adagrad on a bounded sample of the labelled rows; the gradient of a
largest response reaches the words it came from only. One embedding dimension starts at each row's
shrunk log odds, which points the filters at the words worth keeping.

The threshold is calibrated by language on the part of the sample that the network has not seen. A
document's language is guessed from its words; the document's own columns, other than its text, are never
read. A score is moved so that its language's threshold lies at 0.3.

Defined results: null, empty and wordless texts have no response and get the score of the bias; rows of one
id each get a row; without labelled rows of both kinds every score is the base rate (0 without labels); an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.sampling import by_value, held_out
from quern.llm.wordnumbers import WordNumbers

#: Labelled rows of either kind that the classifier is fitted on, at most.
SAMPLE = 2000
BUCKETS, SIZE, FILTERS, WIDTHS, PREFIXES = 1 << 14, 8, 6, (1, 2, 3), (4, 6)
TABLES = 1 + len(PREFIXES)
THRESHOLD = 0.3
SLICE = 1 << 18
_PLAIN = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-case words between ASCII white space and punctuation."""
    return (text or b"").lower().translate(_PLAIN).split()


def hashed(words: list[bytes]) -> np.ndarray:
    """The bucket numbers of each word: its own and its beginnings'."""
    from xxhash import xxh32_intdigest as h

    return np.array([(h(w) % BUCKETS, *(k * BUCKETS + h(w[:n], k) % BUCKETS for k, n in enumerate(PREFIXES, 1))) for w in words], np.int64).reshape(-1, TABLES)


def log_odds(buckets: list[np.ndarray], y: np.ndarray, shrink: float = 8.0) -> np.ndarray:
    """Each bucket's log odds of label 1 over documents that have it, above the base rate's, shrunk to it."""
    seen, ones = np.zeros(TABLES * BUCKETS), np.zeros(TABLES * BUCKETS)
    for b, label in zip(buckets, y, strict=True):
        u = np.unique(b)
        seen[u] += 1
        ones[u] += label
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    p = (ones + shrink * rate) / (seen + shrink)
    return np.log(p / (1 - p)) - np.log(rate / (1 - rate))


@dataclass
class Model:
    embed: np.ndarray  # TABLES * BUCKETS x SIZE
    filters: dict[int, np.ndarray]  # width: width x SIZE x FILTERS
    offsets: dict[int, np.ndarray]
    out: np.ndarray
    bias: float
    languages: list[str] = field(default_factory=list)
    language: np.ndarray | None = None  # TABLES * BUCKETS x languages: log probabilities
    thresholds: list[float] = field(default_factory=list)  # by language, then the one for all
    constant: float | None = None

    def project(self, words: list[bytes]) -> np.ndarray:
        """Each word's part in every filter at each of its places, and in every language."""
        b = hashed(words)
        v = self.embed[b].sum(1)
        cols = [v @ self.filters[w][j] for w in WIDTHS for j in range(w)]
        if self.languages:
            cols.append(self.language[b].sum(1))
        return np.concatenate(cols, axis=1).astype(np.float32)

    def responses(self, rows: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Largest responses of each document (0 where it has no run of the width), documents x filters."""
        full = np.flatnonzero(sizes)
        starts = (np.cumsum(sizes) - sizes)[full]
        out, col = np.zeros((len(sizes), FILTERS * len(WIDTHS)), np.float32), 0
        for k, w in enumerate(WIDTHS):
            total = np.full((len(ids), FILTERS), -np.inf, np.float32)
            if len(ids) >= w:
                own = total[: len(ids) - w + 1]
                own[:] = self.offsets[w]
                for j in range(w):
                    own += rows[ids[j : len(ids) - w + 1 + j], col : col + FILTERS]
                    col += FILTERS
                for j in range(1, w):  # a run may not cross a document's end
                    last = starts + sizes[full] - j
                    total[last[last >= 0]] = -np.inf
            else:
                col += w * FILTERS
            if len(full):
                out[full, k * FILTERS : (k + 1) * FILTERS] = np.maximum(np.maximum.reduceat(total, starts, axis=0), 0)
        return out

    def logits(self, numbers: WordNumbers, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Each document's log odds, and the number of its guessed language (the last: none)."""
        sizes = np.array([len(d) for d in docs], np.int64)
        ids = numbers.of([w for d in docs for w in d])
        z = self.responses(numbers.rows, ids, sizes) @ self.out + self.bias
        lang = np.full(len(docs), len(self.languages))
        full = np.flatnonzero(sizes)
        if self.languages and len(full):
            part = numbers.rows[ids, -len(self.languages) :]
            lang[full] = np.add.reduceat(part, (np.cumsum(sizes) - sizes)[full], axis=0).argmax(1)
        return z, lang

    def scores(self, numbers: WordNumbers, docs: list[list[bytes]]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(docs), self.constant)
        z, lang = self.logits(numbers, docs)
        at = np.array(self.thresholds)[lang]
        # to ten digits, as products over other batches of documents differ in their last bits
        return np.round(1 / (1 + np.exp(-np.clip(z - at + np.log(THRESHOLD / (1 - THRESHOLD)), -500, 500))), 10)

    def numbers(self) -> WordNumbers:
        return WordNumbers(self.project)


def _train(docs: list[list[bytes]], y: np.ndarray, epochs: int, rate: float, seed: int) -> Model:
    rng = np.random.default_rng(seed)
    buckets = [hashed(d).astype(np.int32) for d in docs]
    embed = rng.normal(0, 0.05, (TABLES * BUCKETS, SIZE))
    embed[:, 0] = log_odds(buckets, y)
    filters, offsets = {}, {}
    for w in WIDTHS:
        filters[w] = rng.normal(0, 0.1, (w, SIZE, FILTERS))
        filters[w][:, 0] = np.abs(filters[w][:, 0]) + 0.5 / w
        offsets[w] = np.zeros(FILTERS)
    model = Model(embed, filters, offsets, np.full(FILTERS * len(WIDTHS), 0.2), 0.0)
    rate1 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model.bias = float(np.log(rate1 / (1 - rate1)) - 1)
    seen: dict[str, np.ndarray | float] = {}

    def step(name: str, at: np.ndarray, g: np.ndarray) -> None:
        past = seen.setdefault(name, np.full(at.shape, 1e-2))
        past += g * g
        at -= rate * g / np.sqrt(past)

    past_e, past_b = np.full(TABLES * BUCKETS, 1e-2), 1e-2
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for a in range(0, len(order), 32):
            some = order[a : a + 32]
            g_out, g_bias = np.zeros_like(model.out), 0.0
            g_f = {w: np.zeros_like(filters[w]) for w in WIDTHS}
            g_o = {w: np.zeros(FILTERS) for w in WIDTHS}
            touched, moves = [], []
            for i in some:
                b, n = buckets[i], len(docs[i])
                v = embed[b].sum(1)
                feats, places = np.zeros(len(model.out)), []
                for k, w in enumerate(WIDTHS):
                    if n >= w:
                        r = sum(v[j : n - w + 1 + j] @ filters[w][j] for j in range(w)) + offsets[w]
                        at = r.argmax(0)
                        feats[k * FILTERS : (k + 1) * FILTERS] = np.maximum(r[at, np.arange(FILTERS)], 0)
                        places.append((k, w, at))
                z = feats @ model.out + model.bias
                d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[i]) / len(some)
                g_out += d * feats
                g_bias += d
                for k, w, at in places:
                    g = d * model.out[k * FILTERS : (k + 1) * FILTERS] * (feats[k * FILTERS : (k + 1) * FILTERS] > 0)
                    g_o[w] += g
                    for j in range(w):
                        x = v[at + j]  # filters x size
                        g_f[w][j] += x.T * g
                        touched.append(b[at + j])
                        moves.append(filters[w][j].T * g[:, None])
            step("out", model.out, g_out)
            past_b += g_bias**2
            model.bias -= rate * g_bias / np.sqrt(past_b)
            for w in WIDTHS:
                step(f"f{w}", filters[w], g_f[w])
                step(f"o{w}", offsets[w], g_o[w])
            if touched:
                rows, g = np.concatenate(touched), np.concatenate(moves)
                for c in range(TABLES):
                    u, at = np.unique(rows[:, c], return_inverse=True)
                    total = np.zeros((len(u), SIZE))
                    np.add.at(total, at, g)
                    past_e[u] += (total**2).sum(1)
                    embed[u] -= rate * total / np.sqrt(past_e[u])[:, None]
    return model


def _best_threshold(z: np.ndarray, y: np.ndarray, others: float) -> float:
    """The middle of the gap at which F1 is best, each row of label 0 standing for ``others`` rows."""
    order = np.argsort(-z)
    z, y = z[order], y[order]
    hits = np.cumsum(y)
    f1 = 2 * hits / (hits + others * np.cumsum(1 - y) + y.sum())
    k = int(f1.argmax())
    return float((z[k] + z[k + 1]) / 2 if k + 1 < len(z) else z[k] - 1)


def fit(texts: list[bytes | None], y: np.ndarray, langs: list[str | None], epochs: int = 6, rate: float = 0.05, seed: int = 7, least: int = 8, others: float = 1.0) -> Model:
    """Train on three quarters of the rows, calibrate on the rest; languages with fewer than ``least`` rows of either kind there share a threshold."""
    y = np.asarray(y, float)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros((0, SIZE)), {}, {}, np.zeros(0), 0.0, constant=float(y.mean()) if len(y) else 0.0)
    one: dict[bytes, bytes] = {}  # equal words are one object, else this list is most of what the driver holds
    docs = [[one.setdefault(w, w) for w in words_of(t)] for t in texts]
    kept = np.arange(len(docs)) % 4 == 3 if min(y.sum(), len(y) - y.sum()) >= 8 else np.zeros(len(docs), bool)
    model = _train([docs[i] for i in np.flatnonzero(~kept)], y[~kept], epochs, rate, seed)
    names = sorted({x for x in langs if x})
    counts = np.full((TABLES * BUCKETS, len(names)), 0.5)
    for d, x in zip(docs, langs, strict=True):
        if x:
            np.add.at(counts[:, names.index(x)], hashed(d), 1)
    if names:
        model.languages, model.language = names, np.log(counts / counts.sum(0))
    numbers = model.numbers()
    some = np.flatnonzero(kept) if kept.any() else np.arange(len(docs))
    z, lang = model.logits(numbers, [docs[i] for i in some])
    whole = _best_threshold(z, y[some], others)
    model.thresholds = [whole] * (len(names) + 1)
    for k in range(len(names)):
        own = lang == k
        ones = y[some][own].sum()
        if min(ones, own.sum() - ones) >= least:
            model.thresholds[k] = _best_threshold(z[own], y[some][own], others)
    return model


def labelled(docs: DataFrame, labels: DataFrame, most: int) -> tuple[DataFrame, dict[int, int]]:
    """(text, lang, toxic): at most ``most`` labelled documents of either kind that are not held out; and how many there are.

    Of rows of one id the one with the least text stands for the document.
    """
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(~held_out(F.col("doc_id"), 4))
    some = by_value(known, "toxic", most, ["doc_id"]).select(F.col("doc_id").alias("_tox_id"), "toxic")
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    rows = docs.select("doc_id", "text", lang.alias("lang")).join(F.broadcast(some), F.col("doc_id") == F.col("_tox_id"))
    rows = rows.groupBy("doc_id", "toxic").agg(F.min(F.struct("text", "lang")).alias("row"))
    return rows.select("doc_id", "row.text", "row.lang", "toxic"), counts


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model is fitted in one task, as the driver has no room for the sample's words beside all else."""
    some, counts = labelled(docs, labels, sample)
    others = max(1.0, counts.get(0, 0) / sample) / max(1.0, counts.get(1, 0) / sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda r: r[0])
        order = np.random.default_rng(5).permutation(len(rows))
        rows = [rows[i] for i in order]
        model = fit([r[1].encode() if r[1] else None for r in rows], np.array([r[3] for r in rows]), [r[2] for r in rows], others=others)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    made = some.repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(made["model"]) if made else fit([], np.zeros(0), [])  # an empty table may have no partition


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = model.numbers() if model.constant is None else None
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            a, n, rows = 0, 0, []
            for i, t in enumerate(texts):
                rows.append(words_of(t))
                n += len(rows[-1])
                if n >= SLICE or i + 1 == len(texts):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, i + 1 - a), pa.array(model.scores(numbers, rows).astype(np.float64))], ["doc_id", "score"])
                    a, n, rows = i + 1, 0, []

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    found = scored(docs, learn(docs, labels, sample))
    return found.select("doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` whose text is not predicted toxic, all columns kept."""
    model = learn(docs, labels, sample)
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = model.numbers() if model.constant is None else None
        for batch in batches:
            texts, a, n, rows = batch.column(at).cast(pa.binary()).to_pylist(), 0, 0, []
            for i, t in enumerate(texts):
                rows.append(words_of(t))
                n += len(rows[-1])
                if n >= SLICE or i + 1 == len(texts):
                    yield batch.slice(a, i + 1 - a).filter(pa.array(model.scores(numbers, rows) < THRESHOLD))
                    a, n, rows = i + 1, 0, []

    return docs.mapInArrow(run, docs.schema)
