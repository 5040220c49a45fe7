"""Token ids in Arrow stream files of equal-length sequences.

A file is one Arrow IPC stream. Each row is a sequence of ``LENGTH`` ids and a mask of the same
length (true: an id, false: padding at the file's end; a bit each), both fixed-size lists; every batch but
the last has ``ROWS`` rows. Sequence i is row ``i % ROWS`` of batch ``i // ROWS``; a mapped file gives it, and any
document's ids, as views of its pages without a copy. A second stream beside it, the index, has
(doc_id, first, n_tokens) for each document: the file's ids from ``first`` on. The manifest, one row
for each file, is kept in order of doc_id; a file's base is the number of ids in those before it.

Ids are stored as unsigned 16-bit integers where the vocabulary fits, else 32-bit. A writer that is
lost leaves a file no manifest names; its second run writes another.

Defined results: null text is empty, so it has the end id alone; rows are in ascending doc_id order,
null first, repeated ids in the order of their ids; a text longer than a sequence runs over as many as
it needs; an empty table gives no files and no rows; doc_id must be an int or a bigint (a KeyError says so);
other columns are not read.
"""

from __future__ import annotations

import functools
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import pretokens
from quern.llm.shared import batches_of, fresh

LENGTH, ROWS = 2048, 256
#: Bytes of text in one file, about; the most files, beyond which they grow; rows between two places where a file may end, about.
FILE_BYTES, MOST_FILES, STRIDE = 64 << 20, 20_000, 512
#: Rows in an Arrow batch, at most.
BATCH = 3000
#: Pieces remembered, and characters encoded at a time, about.
MEMO, SLICE = 600_000, 16_000_000
#: Marks that are a token of their own after letters.
MARKS = ".,;:!?"


@functools.lru_cache(maxsize=2)
def _library(vocabulary: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks have a core each
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary)
    t.no_truncation()
    t.no_padding()
    return t


class Encoder:
    """The tokenizers library over texts, called once for each distinct piece while a bounded memo holds it.

    A learnt piece is a row: its ids are a run of ``pool``. Texts are cut and their pieces numbered in Arrow, so
    that Python meets the distinct pieces only, and a text's ids are gathered from the pool.
    """

    def __init__(self, vocabulary: str):
        self.library = _library(vocabulary)
        self.added = [a["content"] for a in pretokens.description(vocabulary)["added_tokens"]]
        self.lengths = np.array([len(b) for b in pretokens.token_bytes(vocabulary)], np.int64)
        self.kind = np.dtype("<u2" if len(self.lengths) <= 1 << 16 else "<u4")
        self._forget()

    def _forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.pool, self.starts, self.counts = np.zeros(0, self.kind), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._extend([self.library.encode(m, add_special_tokens=False).ids for m in MARKS])
        self.marks = {m: i for i, m in enumerate(MARKS)}

    def _extend(self, ids: list[list[int]]) -> np.ndarray:
        """New rows of these ids; their numbers."""
        return self._put(np.array([x for row in ids for x in row], self.kind), np.array([len(row) for row in ids], np.int64))

    def _put(self, flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
        first = len(self.starts)
        self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(counts) - counts])
        self.counts, self.pool = np.concatenate([self.counts, counts]), np.concatenate([self.pool, flat])
        return np.arange(first, len(self.starts))

    def _gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``rows`` one after the other, and where each row's end."""
        counts = self.counts[rows]
        ends = np.cumsum(counts)
        at = np.repeat(self.starts[rows] - (ends - counts), counts)
        at += np.arange(len(at))
        return self.pool[at], ends

    def _learn(self, new: list[str]) -> None:
        """Pieces joined by single spaces are a text that the library cuts at those spaces; the ids' byte lengths tell where."""
        parts, counts = [], []
        for a in range(0, len(new), 100):
            part = new[a : a + 100]
            (e,) = self.library.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)
            ids = np.array(e.ids, np.int64)
            ends = np.cumsum([1 + len(p.encode()) for p in part])
            counts.append(np.diff(np.searchsorted(np.cumsum(self.lengths[ids]), ends) + 1, prepend=0))
            parts.append(ids.astype(self.kind))
        if new:
            self.rows.update(zip(new, self._put(np.concatenate(parts), np.concatenate(counts)).tolist(), strict=True))

    def _rows_of(self, pieces: list[str]) -> np.ndarray:
        """The rows of distinct pieces that a space stands before, those unseen learnt first."""
        get = self.rows.get
        out = np.fromiter((get(p, -1) for p in pieces), np.int64, len(pieces))
        at = np.flatnonzero(out < 0).tolist()
        if not at:
            return out
        unseen, marked, plain, edged = [pieces[i] for i in at], [], [], []
        for p in unseen:
            # letters and one mark are two matches of the pattern, so a word is learnt without its mark
            if p[-1:] in self.marks and p[:-1].isalpha():
                marked.append(p)
            # white space at a piece's ends would meet its neighbour's when pieces are joined
            elif p.isalpha() or p.strip() == p and not pretokens_odd(p):
                plain.append(p)
            else:
                edged.append(p)
        bare = [p[:-1] for p in marked]
        self._learn(list(dict.fromkeys([*plain, *(p for p in bare if p not in self.rows)])))
        self.rows.update(zip(edged, self._extend([e.ids for e in self.library.encode_batch_fast([" " + p for p in edged], add_special_tokens=False)]).tolist(), strict=True))
        if marked:
            both = np.array([[self.rows[p] for p in bare], [self.marks[p[-1]] for p in marked]], np.int64).T
            self.rows.update(zip(marked, self._put(self._gather(both.ravel())[0], self.counts[both].sum(1)).tolist(), strict=True))
        out[at] = np.fromiter(map(self.rows.__getitem__, unseen), np.int64, len(unseen))
        return out

    def encode(self, texts: list[str], end: list[int] | None = None) -> pa.BinaryArray:
        """Each text's ids as little-endian integers of ``kind``, those of ``end`` after them."""
        if len(self.rows) > MEMO:
            self._forget()
        easy = np.array([not pretokens.uneven(t) and not any(a in t for a in self.added) for t in texts], bool)
        cut = pc.split_pattern(pa.array([t for t, x in zip(texts, easy.tolist(), strict=True) if x], pa.large_string()), " ")
        offsets = cut.offsets.to_numpy()
        numbered = cut.flatten().dictionary_encode()
        rows = self._rows_of(numbered.dictionary.to_pylist())[numbered.indices.to_numpy()] if len(numbered) else np.zeros(0, np.int64)
        firsts = numbered.take(pa.array(offsets[:-1])).cast(pa.large_string()).to_pylist() if len(offsets) > 1 else []
        kept = len(self.pool), len(self.starts)
        ids_of = lambda some: self._extend([e.ids for e in self.library.encode_batch_fast(some, add_special_tokens=False)])
        rows[offsets[:-1]] = ids_of(firsts)
        whole = ids_of([t for t, x in zip(texts, easy.tolist(), strict=True) if not x])
        (last,) = self._extend([end or []])
        # the texts' rows in order: of an easy one its pieces', of another its own, and the end's
        sizes = np.ones(len(texts), np.int64)
        sizes[easy] = np.diff(offsets)
        ends = np.cumsum(sizes + 1)
        order = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
        order[ends - 1] = last
        is_end = np.zeros(len(order), bool)
        is_end[ends - 1] = True
        from_cut = np.repeat(easy, sizes + 1)
        order[from_cut & ~is_end] = rows
        order[~from_cut & ~is_end] = whole
        ids, to = self._gather(order)
        self.pool, self.starts, self.counts = self.pool[: kept[0]], self.starts[: kept[1]], self.counts[: kept[1]]
        places = np.concatenate([[0], to[ends - 1]]) * self.kind.itemsize
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(ids)])


def pretokens_odd(piece: str) -> bool:
    """Characters that Python and the library may hold for white space differently."""
    return not piece or piece[0] in "\x1c\x1d\x1e\x1f" or piece[-1] in "\x1c\x1d\x1e\x1f"


@functools.lru_cache(maxsize=2)
def encoder(vocabulary: str) -> Encoder:
    return Encoder(vocabulary)


def schemas(kind: pa.DataType, id_type: pa.DataType) -> tuple[pa.Schema, pa.Schema]:
    of = lambda t: pa.list_(pa.field("item", t, nullable=False), LENGTH)
    return pa.schema([("ids", of(kind)), ("mask", of(pa.bool_()))]), pa.schema([("doc_id", id_type), ("first", pa.int64()), ("n_tokens", pa.int64())])


class Writer:
    """One file and its index, of documents in the order they come."""

    def __init__(self, uri: str, kind: np.dtype, id_type: pa.DataType):
        fs, path = pafs.FileSystem.from_uri(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.kind, self.n, self.docs = kind, 0, 0
        data, index = schemas(pa.from_numpy_dtype(kind), id_type)
        self.outs = [fs.open_output_stream(path), fs.open_output_stream(path + ".index")]
        self.data, self.index = (pa.ipc.new_stream(f, s) for f, s in zip(self.outs, (data, index), strict=True))
        self.left: list[bytes] = []
        self.held = 0

    def _rows(self, raw: bytes, n: int) -> None:
        ids = np.zeros(-(-n // LENGTH) * LENGTH, self.kind)
        ids[:n] = np.frombuffer(raw, self.kind)
        mask = np.zeros(len(ids), bool)
        mask[:n] = True
        s = self.data_schema
        self.data.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(x), type=f.type) for x, f in zip((ids, mask), s, strict=True)], schema=s))

    @property
    def data_schema(self) -> pa.Schema:
        return schemas(pa.from_numpy_dtype(self.kind), pa.int64())[0]

    def add(self, doc_ids: pa.Array, rows: list[bytes]) -> None:
        counts = np.array([len(x) // self.kind.itemsize for x in rows], np.int64)
        first = self.n + np.cumsum(counts) - counts
        self.index.write_batch(pa.RecordBatch.from_arrays([doc_ids, pa.array(first), pa.array(counts)], ["doc_id", "first", "n_tokens"]))
        self.n, self.docs = self.n + int(counts.sum()), self.docs + len(rows)
        self.left += rows
        self.held += int(counts.sum())
        whole = LENGTH * ROWS
        if self.held >= whole:
            raw = memoryview(b"".join(self.left))
            step, at = whole * self.kind.itemsize, 0
            while len(raw) - at >= step:
                self._rows(raw[at : at + step], whole)
                at += step
            self.left, self.held = [bytes(raw[at:])], (len(raw) - at) // self.kind.itemsize

    def close(self) -> None:
        if self.held:
            self._rows(b"".join(self.left), self.held)
        for x in (self.data, self.index, *self.outs):
            x.close()


class Reader:
    """Random access to a file: sequences with their masks, and runs of ids, as views."""

    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        local = isinstance(fs, pafs.LocalFileSystem)
        opened = lambda p: pa.memory_map(p) if local else pa.BufferReader(fs.open_input_stream(p).read())
        self.index = pa.ipc.open_stream(opened(path + ".index"))
        self.batches = list(pa.ipc.open_stream(opened(path)))
        self.ids = [b.column(0).flatten().to_numpy(zero_copy_only=True) for b in self.batches]
        self.masks = [b.column(1).flatten() for b in self.batches]

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def sequence(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        b, r = divmod(i, ROWS)
        return self.ids[b][r * LENGTH : (r + 1) * LENGTH], self.masks[b].slice(r * LENGTH, LENGTH)

    def run(self, first: int, n: int) -> np.ndarray:
        """``n`` ids from ``first`` on: a view unless they cross a batch."""
        whole = LENGTH * ROWS
        b, at = divmod(first, whole)
        if at + n <= whole:
            return self.ids[b][at : at + n]
        parts = []
        while n:
            parts.append(self.ids[b][at : at + n])
            n, b, at = n - len(parts[-1]), b + 1, 0
        return np.concatenate(parts)


def _cuts(docs: DataFrame, file_bytes: int) -> np.ndarray:
    """Ids at which files end, with about ``file_bytes`` bytes of text between two.

    Ids near quantiles of the rows are where a file may end; the texts' bytes between them are summed, so the driver
    sees a bounded number of sums.
    """
    n = docs.filter("doc_id IS NOT NULL").count()
    places = min(16 * MOST_FILES, n // STRIDE)
    if not places:
        return np.zeros(0, np.int64)
    some = docs.agg(F.percentile_approx("doc_id", [k / places for k in range(1, places)], 4 * places)).first()[0] if places > 1 else []
    some = np.array(sorted(set(some or [])), np.int64)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(some) + 1, np.int64)
        for batch in batches:
            total += np.bincount(np.searchsorted(some, batch.column(0).to_numpy(), "left"), batch.column(1).to_numpy(), len(total)).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["place", "bytes"])

    sized = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    total = np.zeros(len(some) + 1, np.int64)
    for r in sized.mapInArrow(sums, "place long, bytes long").groupBy("place").agg(F.sum("bytes").alias("bytes")).collect():
        total[r["place"]] = r["bytes"]
    step = max(file_bytes, -(-int(total.sum()) // MOST_FILES))
    file = (np.cumsum(total) - 1) // step
    return some[np.flatnonzero(file[1:] != file[:-1])]


def write(docs: DataFrame, folder: str | None = None, vocabulary: str | None = None, end: int = 0, file_bytes: int = FILE_BYTES) -> tuple[str, list[dict]]:
    """Encode every text, end it with ``end``, and write the files. Returns the folder and the manifest."""
    spark = docs.sparkSession
    vocabulary = vocabulary or pretokens.default_vocabulary()
    folder = folder or fresh(spark, "tokens")
    if docs.select("doc_id").isEmpty():
        return folder, []
    cuts = _cuts(docs.select("doc_id", "text"), file_bytes)
    id_type = {"int": pa.int32(), "bigint": pa.int64()}[docs.schema["doc_id"].dataType.simpleString()]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        for batch in batches:
            own, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            # a document with the cut's own id goes below it; null, the first in order, to file 0
            part = np.searchsorted(cuts, own.fill_null(np.iinfo(np.int32).min).to_numpy(zero_copy_only=False), "left")
            part[own.is_null().to_numpy(zero_copy_only=False)] = 0
            for a, b in pretokens.slices(texts, SLICE):
                yield pa.RecordBatch.from_arrays([pa.array(part[a:b], pa.int32()), own.slice(a, b - a), coder.encode(texts[a:b], [end]).cast(pa.binary())], ["part", "doc_id", "ids"])

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[int, tuple[str, Writer]] = {}
        kind = encoder(vocabulary).kind
        for batch in batches:
            parts = batch.column(0).to_numpy()
            for k in np.unique(parts).tolist():
                if k not in open_:  # rows come sorted by part
                    for _, w in open_.values():
                        w.close()
                    uri = f"{folder}/part-{k:06d}-{uuid.uuid4().hex}.arrows"
                    yield from done(open_)
                    open_ = {k: (uri, Writer(uri, kind, id_type))}
                at = np.flatnonzero(parts == k)
                some = batch.slice(int(at[0]), len(at))
                open_[k][1].add(some.column(1), some.column(2).to_pylist())
        for _, w in open_.values():
            w.close()
        yield from done(open_)

    def done(open_: dict) -> Iterator[pa.RecordBatch]:
        for k, (uri, w) in open_.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([uri]), pa.array([w.docs], pa.int64()), pa.array([w.n], pa.int64())], ["part", "uri", "docs", "tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    coded = docs.select("doc_id", "text").mapInArrow(encode, f"part int, doc_id {kind}, ids binary")
    made = coded.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("part", "doc_id", "ids").mapInArrow(save, "part int, uri string, docs long, tokens long")
    manifest, base = [], 0
    with batches_of(spark, BATCH):
        files = made.collect()  # a row for each file
    for r in sorted(files, key=lambda r: r["part"]):
        manifest.append(r.asDict() | {"base": base})
        base += r["tokens"]
    return folder, manifest


def read(spark: SparkSession, manifest: list[dict], id_type: str = "bigint") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = Reader(uri)
                for index in file.index:
                    first, n = (index.column(k).to_numpy() for k in (1, 2))
                    crc = [zlib.crc32(file.run(a, b).astype("<u4").tobytes()) for a, b in zip(first.tolist(), n.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([index.column(0), pa.array(first + base), index.column(2), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = spark.createDataFrame([(m["uri"], m["base"]) for m in manifest], "uri string, base long")
    return files.repartition(max(1, len(manifest))).mapInArrow(run, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


def write_and_read(docs: DataFrame, **how) -> DataFrame:
    _, manifest = write(docs, **how)
    return read(docs.sparkSession, manifest, docs.schema["doc_id"].dataType.simpleString())
