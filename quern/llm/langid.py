"""Language ID: a bidirectional gated recurrent network over bytes.

One network reads a text's bytes forwards, one backwards; at every position a softmax over both states
labels the byte, and a document's probabilities are the mean over all its positions. A text is read in windows of about
``WINDOW`` bytes, cut between characters: states run on across words and start anew with each window. Windows
are read side by side, as lanes of one array, the longest first, so that those still being read are its first rows.
Training is backpropagation through time in numpy with Adam, on windows of a bounded sample of documents of each
language.

Defined results: null texts and texts without a letter are ``und`` with score 0; without documents to learn
from all are; of languages with equal probabilities the first in order is taken; every byte of a text of any
length counts; rows of one id each get a row; an empty table gives no rows; of the columns only doc_id, text
and, to learn from, lang are read. Scores are given to six digits. Beyond ``VALUES`` languages the most frequent are learnt.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.sampling import by_value, held_out

#: Documents of each language that the network is fitted on, at most; windows of each language, and their bytes.
SAMPLE, TRAINED, LENGTHS = 120, 2400, (96, 96, 24)
STATE, WINDOW, LANES = 12, 256, 1024
SLICE = 1 << 21
UNKNOWN = "und"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Direction:
    """A gated recurrent layer: ``byte`` holds each byte's part in the update gate, the reset gate and the new state."""

    byte: np.ndarray  # 256 x 3 STATE
    gates: np.ndarray  # STATE x 2 STATE
    new: np.ndarray  # STATE x STATE

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> Direction:
        return cls(*(rng.normal(0, s, shape).astype(np.float32) for s, shape in ((0.3, (256, 3 * STATE)), (0.3, (STATE, 2 * STATE)), (0.3, (STATE, STATE)))))

    def forward(self, x: np.ndarray, keep: bool = False):
        """States after each of ``x``'s columns; with ``keep`` also what backward() needs."""
        h, states, past = np.zeros((len(x), STATE), np.float32), [], []
        for t in range(x.shape[1]):
            own = self.byte[x[:, t]]
            g = _sigmoid(own[:, : 2 * STATE] + h @ self.gates)
            z, r = g[:, :STATE], g[:, STATE:]
            n = np.tanh(own[:, 2 * STATE :] + (r * h) @ self.new)
            past.append((h, z, r, n))
            h = h + z * (n - h)
            states.append(h)
        return (states, past) if keep else states

    def backward(self, x: np.ndarray, past: list, d_states: list[np.ndarray]) -> list[np.ndarray]:
        """Gradients of (byte, gates, new), through time."""
        g_byte, g_gates, g_new = (np.zeros_like(a) for a in (self.byte, self.gates, self.new))
        d = np.zeros((len(x), STATE), np.float32)
        for t in reversed(range(x.shape[1])):
            h, z, r, n = past[t]
            d = d + d_states[t]
            dn = d * z * (1 - n * n)
            drh = dn @ self.new.T
            dg = np.concatenate([d * (n - h) * z * (1 - z), drh * h * r * (1 - r)], axis=1)
            g_new += (r * h).T @ dn
            g_gates += h.T @ dg
            np.add.at(g_byte, x[:, t], np.concatenate([dg, dn], axis=1))
            d = d * (1 - z) + drh * r + dg @ self.gates.T
        return [g_byte, g_gates, g_new]


class Reading:
    """A layer's weights laid out for reading many lanes a byte at a time, in place."""

    def __init__(self, layer: Direction):
        part = lambda m: [np.ascontiguousarray(m[:, a : a + STATE]) for a in range(0, m.shape[1], STATE)]
        self.byte, self.gates, self.new = part(layer.byte), part(layer.gates), layer.new

    def step(self, x: np.ndarray, h: np.ndarray) -> None:
        """Lanes' states ``h`` after their next bytes ``x``."""
        gate = []
        for byte, own in zip(self.byte[:2], self.gates, strict=True):
            g = byte[x]
            g += h @ own
            np.negative(g, g)
            np.exp(g, g)
            g += 1
            gate.append(np.reciprocal(g, g))
        z, r = gate
        r *= h
        n = self.byte[2][x]
        n += r @ self.new
        np.tanh(n, n)
        n -= h
        n *= z
        h += n


@dataclass
class Model:
    languages: list[str]
    ahead: Direction | None = None
    back: Direction | None = None
    out: np.ndarray | None = None  # 2 STATE x languages
    bias: np.ndarray | None = None

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Label probabilities at every position of equally long sequences: sequences x positions x languages."""
        a, b = self.ahead.forward(x), self.back.forward(x[:, ::-1])[::-1]
        logits = np.stack([np.concatenate([p, q], axis=1) @ self.out + self.bias for p, q in zip(a, b, strict=True)], axis=1)
        e = np.exp(logits - logits.max(2, keepdims=True))
        return e / e.sum(2, keepdims=True)

    def sums(self, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Each window's sums of label probabilities over its positions."""
        out = np.zeros((len(starts), len(self.languages)))
        ahead, back, order = Reading(self.ahead), Reading(self.back), np.argsort(-lengths, kind="stable")
        for a in range(0, len(order), LANES):
            some = order[a : a + LANES]
            width = -(-len(some) // 64) * 64  # rows in whole blocks, so that a lane's sums do not depend on its neighbours
            start, size = np.zeros(width, np.int64), np.zeros(width, np.int64)
            start[: len(some)], size[: len(some)] = starts[some], lengths[some]
            live = -(-np.searchsorted(-size, -np.arange(size[0]), "left") // 64) * 64
            part = np.empty((size[0], width, len(self.languages)), np.float32)
            h = np.zeros((width, STATE), np.float32)
            for t, n in enumerate(live.tolist()):
                ahead.step(flat[np.minimum(start[:n] + t, len(flat) - 1)], h[:n])
                part[t, :n] = h[:n] @ self.out[:STATE]
            h[:] = 0
            total, lane = np.zeros((width, len(self.languages))), np.arange(width)
            for t, n in enumerate(live.tolist()):
                at = np.maximum(size[:n] - 1 - t, 0)
                back.step(flat[start[:n] + at], h[:n])
                p = part[at, lane[:n]]
                p += h[:n] @ self.out[STATE:]
                p += self.bias
                p -= p.max(1, keepdims=True)
                np.exp(p, p)
                p /= p.sum(1, keepdims=True)
                p[size[:n] <= t] = 0
                total[:n] += p
            out[some] = total[: len(some)]
        return out

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Each text's probabilities (zeros without a byte)."""
        out = np.zeros((len(texts), len(self.languages)))
        flat, starts, lengths, owner = windows(texts)
        if len(starts):
            np.add.at(out, owner, self.sums(flat, starts, lengths))
            out /= np.maximum([[len(t)] for t in texts], 1)
        return out


def windows(texts: list[bytes], size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts' bytes, and the start, length and text of each window: about ``size`` bytes, cut between characters."""
    flat = np.frombuffer(b"".join(texts), np.uint8)
    lengths = np.array([len(t) for t in texts], np.int64)
    first, count = np.cumsum(lengths) - lengths, -(-lengths // size)
    owner = np.repeat(np.arange(len(texts)), count)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    starts = first[owner] + number * size
    for _ in range(3):
        starts -= (number > 0) & (flat[starts] & 0xC0 == 0x80) if len(starts) else 0
    ends = np.append(starts[1:], 0)
    last = np.append(owner[1:] != owner[:-1], True)[: len(owner)]
    return flat, starts, np.where(last, (first + lengths)[owner], ends) - starts, owner


def _examples(texts: list[bytes], langs: list[str], names: list[str], rng: np.random.Generator) -> dict[int, list[tuple[bytes, int, float]]]:
    """Windows of the texts by length, as many of each language as ``TRAINED`` says, all of a language weighing alike."""
    by_length: dict[int, list[tuple[bytes, int, float]]] = defaultdict(list)
    for k, name in enumerate(names):
        own = []
        for t, x in zip(texts, langs, strict=True):
            at = 0
            while x == name and at < len(t):
                n = LENGTHS[int(rng.integers(len(LENGTHS)))]
                own.append(t[at : at + n])
                at += n
        own = [own[i] for i in rng.permutation(len(own))[:TRAINED]]
        for w in own:
            by_length[len(w)].append((w, k, len(w) / sum(map(len, own))))
    return by_length


def fit(texts: list[bytes], langs: list[str], epochs: int = 2, rate: float = 0.01, batch: int = 96, seed: int = 11) -> Model:
    """Train on windows of the texts: every position of a window is labelled with its text's language."""
    names = sorted(set(langs))
    if len(names) < 2:
        return Model(names)
    rng = np.random.default_rng(seed)
    by_length = _examples(texts, langs, names, rng)
    mean = np.mean([w / len(x) for some in by_length.values() for x, _, w in some])
    model = Model(names, Direction.fresh(rng), Direction.fresh(rng), rng.normal(0, 0.3, (2 * STATE, len(names))).astype(np.float32), np.zeros(len(names), np.float32))
    params = [model.ahead.byte, model.ahead.gates, model.ahead.new, model.back.byte, model.back.gates, model.back.new, model.out, model.bias]
    m1, m2, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        batches = []
        for n, some in by_length.items():
            order = rng.permutation(len(some))
            batches += [(n, [some[i] for i in order[a : a + batch]]) for a in range(0, len(order), batch)]
        for i in rng.permutation(len(batches)):
            n, some = batches[i]
            x = np.frombuffer(b"".join(s for s, _, _ in some), np.uint8).reshape(-1, n)
            y = np.array([k for _, k, _ in some])
            weight = np.array([w / n / mean for _, _, w in some], np.float32)
            (a, past_a), (b, past_b) = model.ahead.forward(x, True), model.back.forward(x[:, ::-1], True)
            g_out, g_bias, d_a, d_b = np.zeros_like(model.out), np.zeros_like(model.bias), [], []
            for t in range(n):
                both = np.concatenate([a[t], b[n - 1 - t]], axis=1)
                logits = both @ model.out + model.bias
                e = np.exp(logits - logits.max(1, keepdims=True))
                p = e / e.sum(1, keepdims=True)
                p[np.arange(len(y)), y] -= 1
                p *= (weight / (n * len(y)))[:, None]
                g_out += both.T @ p
                g_bias += p.sum(0)
                d = p @ model.out.T
                d_a.append(d[:, :STATE])
                d_b.append(d[:, STATE:])
            grads = [*model.ahead.backward(x, past_a, d_a), *model.back.backward(x[:, ::-1], past_b, d_b[::-1]), g_out, g_bias]
            step += 1
            share = np.float32(min(1.0, len(some) / batch))  # a batch of few windows moves the weights less
            for p, g, u, v in zip(params, grads, m1, m2, strict=True):
                u += 0.1 * (g - u)
                v += 0.01 * (g * g - v)
                p -= share * rate * (u / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


def learn(docs: DataFrame, sample: int = SAMPLE) -> Model:
    known = docs.select("doc_id", "text", "lang").filter("lang IS NOT NULL AND text IS NOT NULL").filter(~held_out(F.col("doc_id"), 4))
    rows = by_value(known, "lang", sample, ["doc_id", "text"]).collect()
    rows.sort(key=lambda r: (r["lang"], r["doc_id"] is None, r["doc_id"] or 0, r["text"]))
    return fit([r["text"].encode() for r in rows], [r["lang"] for r in rows])


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, a, n = batch.column(1).to_pylist(), 0, 0
            for i, t in enumerate(texts):
                n += len(t or "")
                if n < SLICE and i + 1 < len(texts):
                    continue
                part = texts[a : i + 1]
                letters = [bool(t) and has_letter(t) for t in part]
                if len(model.languages) > 1:
                    p = model.pooled([t.encode() if x else b"" for t, x in zip(part, letters, strict=True)])
                else:
                    p = np.ones((len(part), len(model.languages)))
                lang = [model.languages[k] if x and model.languages else UNKNOWN for k, x in zip(p.argmax(1).tolist() if p.shape[1] else [0] * len(part), letters, strict=True)]
                score = np.where(np.array(letters, bool), p.max(1) if p.shape[1] else 0.0, 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, i + 1 - a), pa.array(lang, pa.string()), pa.array(np.round(np.clip(score, 0, 1), 6))], ["doc_id", "lang_pred", "score"])
                a, n = i + 1, 0

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def languages(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row."""
    return predicted(docs, learn(docs, sample)).select("doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), "lang_pred", "score")
