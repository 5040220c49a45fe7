"""BPE encoding and decoding.

Frequent words, with their ids, are compiled into a minimal acyclic automaton whose equal suffixes
are shared. Each arc carries how many words branch off before it, so the sum along a word's path is
the word's number and with it the place of its ids: the automaton is a transducer to id sequences. It
is one Arrow file in the shared folder, memory-mapped by the workers. Words outside it are merged
exactly, many at a time: each round merges every word's leftmost pair of lowest rank.

Which words are frequent changes speed only, never results: a word that holds at least ``1 / most``
of some task's words is a candidate, and of all candidates those with ``1 / most`` of the counted words are
kept, so there are ``most`` at most.

Defined results: null text is empty and has no ids; a special token's string in a text is that token,
as the library has it; texts of any length are encoded whole (a word of over 48 bytes is merged with a
heap); rows of equal id each give a row; other columns are not read.
"""

from __future__ import annotations

import functools
import heapq
import hashlib
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import pretokens
from quern.llm.shared import fresh

NONE = np.iinfo(np.int32).max
WIDE = 48
MEMO = 300_000


class Merges:
    """The vocabulary's merges, as a hash table over pairs of ids."""

    def __init__(self, path: str):
        model = pretokens.description(path)["model"]
        vocab = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.byte_ids = np.array([vocab[c] for c in pretokens.byte_letters()], np.int64)
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        into = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.of = {(a, b): (r, i) for r, (a, b, i) in enumerate(zip(left.tolist(), right.tolist(), into.tolist(), strict=True))}
        self.bits = max(8, int(len(pairs)).bit_length() + 3)
        size = 1 << self.bits
        self.keys, self.at = np.full(size, -1, np.int64), np.full(size, -1, np.int32)
        self.into, self.probes = into, 1
        slot = self._slot(left << 32 | right).tolist()
        for r, (key, s) in enumerate(zip((left << 32 | right).tolist(), slot, strict=True)):
            n = 1
            while self.keys[s] >= 0:
                s, n = (s + 1) & (size - 1), n + 1
            self.keys[s], self.at[s], self.probes = key, r, max(self.probes, n)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        slot, out = self._slot(key), np.full(key.shape, NONE, np.int32)
        for _ in range(self.probes):
            hit = self.keys[slot] == key
            out[hit] = self.at[slot[hit]]
            slot = (slot + 1) & ((1 << self.bits) - 1)
        return out

    def one(self, word: bytes) -> list[int]:
        """A single word of any length, with a heap of (rank, place)."""
        ids: list[int] = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        heap = [(self.of[p][0], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in self.of]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = int(self.into[rank]), -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (p := (ids[x], ids[y])) in self.of:
                    heapq.heappush(heap, (self.of[p][0], x, *p))
        return [i for i in ids if i >= 0]

    def many(self, words: list[bytes], n: int) -> list[np.ndarray]:
        """Words of ``n`` bytes each, merged in rounds."""
        ids = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)].reshape(-1, n).astype(np.int32)
        rank = np.full((len(ids), n), NONE, np.int32)
        if n > 1:
            rank[:, :-1] = self.ranks(ids[:, :-1], ids[:, 1:])
        out: list[np.ndarray] = [None] * len(words)  # type: ignore[list-item]
        own, width = np.arange(len(ids)), np.full(len(ids), n)
        while len(own):
            at = rank.argmin(1)
            row = np.arange(len(own))
            low = rank[row, at]
            if (ended := low == NONE).any():
                for k in np.flatnonzero(ended):
                    out[own[k]] = ids[k, : width[k]].copy()
                go = ~ended
                ids, rank, own, width, at, low = ids[go], rank[go], own[go], width[go], at[go], low[go]
                row = np.arange(len(own))
                if not len(own):
                    break
            later = np.arange(ids.shape[1] - 1) > at[:, None]
            ids[:, :-1] = np.where(later, ids[:, 1:], ids[:, :-1])
            rank[:, :-1] = np.where(later, rank[:, 1:], rank[:, :-1])
            rank[:, -1] = NONE
            ids[row, at] = self.into[low]
            width -= 1
            right = np.minimum(at + 1, ids.shape[1] - 1)
            rank[row, at] = np.where(at + 1 < width, self.ranks(ids[row, at], ids[row, right]), NONE)
            if (left := at > 0).any():
                r, c = row[left], at[left]
                rank[r, c - 1] = self.ranks(ids[r, c - 1], ids[r, c])
            ids, rank = ids[:, : max(2, width.max())], rank[:, : max(2, width.max())]
        return out


@functools.lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    return Merges(path)


def encode_words(words: list[bytes], vocabulary: str, lexicon: Lexicon | None = None) -> dict[bytes, np.ndarray]:
    """Each pre-token's ids: from the lexicon if it is there, else merged."""
    of, by_length, found = merges(vocabulary), defaultdict(list), {}
    for w in words:
        by_length[len(w)].append(w)
    for n, group in by_length.items():
        if not n:
            found[b""] = np.zeros(0, np.int32)
        elif n > WIDE:
            found |= {w: np.array(of.one(w), np.int32) for w in group}
        else:
            if lexicon is not None:
                known, group = lexicon.look_up(group, n)
                found |= known
            if group:
                found |= zip(group, of.many(group, n), strict=True)
    return found


class Lexicon:
    """A minimal acyclic automaton over words; the sum of its arcs' outputs numbers the words."""

    FIELDS = ("first", "byte", "to", "out", "final", "starts", "ids")

    def __init__(self, **arrays: np.ndarray):
        for k in self.FIELDS:
            setattr(self, k, arrays[k])
        n = len(self.first) - 1
        self.keys = np.repeat(np.arange(n, dtype=np.int64), np.diff(self.first)) << 8 | self.byte

    @classmethod
    def built(cls, words: dict[bytes, np.ndarray]) -> Lexicon:
        """Sorted words are added one after another; a state no later word can pass is merged with its equal, if one is kept."""
        register: dict[tuple, int] = {}
        states: list[tuple] = []  # kept: (final, ((byte, state), ...))

        def keep(node: list) -> int:
            key = (node[0], tuple(node[1]))
            if key not in register:
                register[key] = len(states)
                states.append(key)
            return register[key]

        path, last = [[False, []]], b""
        order = sorted(words)
        for w in order:
            same = next((i for i, (a, b) in enumerate(zip(w, last)) if a != b), min(len(w), len(last)))
            while len(path) > same + 1:
                node = path.pop()
                path[-1][1].append((last[len(path) - 1], keep(node)))
            for _ in w[same:]:
                path.append([False, []])
            path[-1][0], last = True, w
        while len(path) > 1:
            node = path.pop()
            path[-1][1].append((last[len(path) - 1], keep(node)))
        start = keep(path[0])
        words_below = [0] * len(states)
        first, byte, to, out = [0], [], [], []
        for i, (final, arcs) in enumerate(states):  # children are kept before their parents
            n = int(final)
            for b, t in arcs:
                byte.append(b)
                to.append(t)
                out.append(n)
                n += words_below[t]
            words_below[i] = n
            first.append(len(byte))
        ids = [words[w] for w in order]
        at = lambda x, kind: np.array(x, kind)
        return cls(first=at(first, np.int32), byte=at(byte, np.uint8), to=at(to, np.int32), out=at(out, np.int32), final=at([*(f for f, _ in states)] + [False] * (start != len(states) - 1), np.uint8),
                   starts=np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)]).astype(np.int32), ids=np.concatenate(ids).astype(np.int32) if ids else at([], np.int32))

    def look_up(self, words: list[bytes], n: int) -> tuple[dict[bytes, np.ndarray], list[bytes]]:
        """Of words of ``n`` bytes each: the ids of those that it has, and the others."""
        if not len(self.keys):
            return {}, words
        m = np.frombuffer(b"".join(words), np.uint8).reshape(-1, n)
        live, number = np.arange(len(words)), np.zeros(len(words), np.int64)
        state = np.full(len(words), len(self.first) - 2, np.int64)
        for j in range(n):
            key = state << 8 | m[live, j]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            live, at = live[hit], at[hit]
            number[live] += self.out[at]
            state = self.to[at].astype(np.int64)
        live = live[self.final[state] > 0]
        found = {words[i]: self.ids[self.starts[k] : self.starts[k + 1]] for i, k in zip(live.tolist(), number[live].tolist(), strict=True)}
        rest = np.ones(len(words), bool)
        rest[live] = False
        return found, [words[i] for i in np.flatnonzero(rest).tolist()]

    def save(self, uri: str) -> None:
        fs, path = pafs.FileSystem.from_uri(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        fields = [getattr(self, k) for k in self.FIELDS]
        with fs.open_output_stream(path) as f:
            t = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)) for x in fields], list(self.FIELDS))
            with pa.ipc.new_file(f, t.schema) as w:
                w.write_batch(t)

    @staticmethod
    @functools.lru_cache(maxsize=2)
    def mapped(uri: str) -> Lexicon:
        """The automaton over the file's own pages where the folder is a mounted one; else read once for each worker."""
        fs, path = pafs.FileSystem.from_uri(uri)
        source = pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)
        batch = pa.ipc.open_file(source).get_batch(0)
        return Lexicon(**{k: batch.column(i).values.to_numpy(zero_copy_only=True) for i, k in enumerate(Lexicon.FIELDS)})


class Encoder:
    """Texts to ids, with a bounded memo over pieces."""

    def __init__(self, vocabulary: str, lexicon: Lexicon | None = None):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        added = [a["content"] for a in pretokens.description(vocabulary)["added_tokens"]]
        self.added = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.added_ids = {a["content"]: np.array([a["id"]], np.int32).tobytes() for a in pretokens.description(vocabulary)["added_tokens"]}
        self.words = regex.compile(pretokens.PATTERN)
        self.rest: dict[str, bytes] = {}
        self.first: dict[str, bytes] = {}

    def _learn(self, new: Iterable[str], memo: dict[str, bytes], before: str) -> None:
        new = list(new)
        parts = [[w.encode() for w in self.words.findall(before + p)] for p in new]
        of = encode_words(list({w for p in parts for w in p}), self.vocabulary, self.lexicon)
        raw = {w: np.asarray(x, np.int32).tobytes() for w, x in of.items()}
        for p, ws in zip(new, parts, strict=True):
            memo[p] = raw[ws[0]] if len(ws) == 1 else b"".join([raw[w] for w in ws])

    def _plain(self, texts: list[str]) -> list[bytes]:
        if len(self.rest) > MEMO or len(self.first) > MEMO:
            self.rest, self.first = {}, {}
        cut = [pretokens.pieces(t) for t in texts]
        seen: set[str] = set()
        firsts: set[str] = set()
        for t, p in zip(texts, cut, strict=True):
            if p is None:
                firsts.update(self.words.findall(t))
            else:
                seen.update(p[1:])
                firsts.add(p[0])
        self._learn(seen.difference(self.rest), self.rest, " ")
        self._learn(firsts.difference(self.first), self.first, "")
        rest, first = self.rest.__getitem__, self.first.__getitem__
        return [b"".join(map(first, self.words.findall(t))) if p is None else first(p[0]) + b"".join(map(rest, p[1:])) for t, p in zip(texts, cut, strict=True)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        odd = {i: self.added.split(t) for i, t in enumerate(texts) if self.added and self.added.search(t)} if self.added and any(map(self._has, texts)) else {}
        plain = [t for i, t in enumerate(texts) if i not in odd] + [s for parts in odd.values() for s in parts[::2]]
        got = iter(self._plain(plain))
        out = [None if i in odd else next(got) for i in range(len(texts))]
        for i, parts in odd.items():
            out[i] = b"".join(self.added_ids[s] if k % 2 else next(got) for k, s in enumerate(parts))
        return [np.frombuffer(x, np.int32) for x in out]

    def _has(self, text: str) -> bool:
        return any(a in text for a in self.added_ids)


def decode(ids: np.ndarray, table: list[bytes]) -> bytes:
    """The ids' bytes joined; bytes that are no UTF-8 become the replacement character, as in the library."""
    raw = b"".join(map(table.__getitem__, ids.tolist()))
    try:
        raw.decode()
    except UnicodeDecodeError:
        raw = raw.decode("utf-8", "replace").encode()
    return raw


@functools.lru_cache(maxsize=1)
def encoder(vocabulary: str, lexicon: str | None) -> Encoder:
    return Encoder(vocabulary, Lexicon.mapped(lexicon) if lexicon else None)


def frequent_words(docs: DataFrame, vocabulary: str, most: int) -> dict[bytes, np.ndarray]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        total = 0

        def flush(all_: bool = False) -> list[tuple[str, int]]:
            least = max(2, total // most)
            return [(w, n) for w, n in seen.items() if n >= least]

        for batch in batches:
            for t in batch.column(0).to_pylist():
                p = (t or "").split(" ")[1:]
                total += len(p)
                seen.update(p)
                if len(seen) > 3 * most:
                    seen = Counter(dict(seen.most_common(most)))
        kept = flush()
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([total], pa.int64())], ["word", "n"])

    counted = docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.col("word").isNotNull(), F.desc("n"), "word").limit(most + 1).collect()
    total = next((r["n"] for r in top if r["word"] is None), 0)
    words = [b" " + r["word"].encode() for r in top if r["word"] and r["n"] * most >= total]
    pattern = regex.compile(pretokens.PATTERN)
    parts = {w.encode() for x in words for w in pattern.findall(x.decode()) if len(w.encode()) <= WIDE}
    return encode_words(sorted(parts), vocabulary)


def encode_decode(docs: DataFrame, vocabulary: str | None = None, most: int = 50_000, keep: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row; with ``keep`` also the ids and the decoded text."""
    vocabulary = vocabulary or pretokens.default_vocabulary()
    lexicon = fresh(docs.sparkSession, "lexicon") + "/words.arrow"
    Lexicon.built(frequent_words(docs, vocabulary, most)).save(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, table = encoder(vocabulary, lexicon), pretokens.token_bytes(vocabulary)
        digits = [str(i) for i in range(len(table))].__getitem__
        for batch in batches:
            own, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in pretokens.slices(texts):
                rows = coder.encode(texts[a:b])
                raw = [decode(x, table) for x in rows]
                made = [
                    own.slice(a, b - a),
                    pa.array([len(x) for x in rows], pa.int64()),
                    pa.array([hashlib.sha256(",".join(map(digits, x.tolist())).encode()).hexdigest() for x in rows], pa.string()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string()),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep:
                    made += [pa.array([x.tolist() for x in rows], pa.list_(pa.int32())), pa.array(raw, pa.binary()).cast(pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(made, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if keep else "")
    return docs.select("doc_id", "text").mapInArrow(run, schema)
