"""Embedding near-duplicates with hierarchical navigable small-world graphs, one per shard.

Equal vectors are one entry, with the number of its copies. Entries are dealt to shards by hash; a shard's
graph is one Arrow file in the shared folder. A node's place follows from its id's hash, and its level from its place, so
a layer's nodes are the first ones. Each layer is built by inserting its nodes in growing batches: a batch is
sought in the graph so far, and a node is linked to found ones that are nearer to it than to each other, and back;
nodes that no link leads to get one. Every entry is then sought in every shard: down the upper layers
greedily, over the lowest with a beam, many entries at a time. A beam that ends full of links is
followed on, through links only, until no link is left unseen.

A graph is audited before use: for samples of its own entries, of the whole table's, and of vectors made to be just near
enough to an entry, all links are found by brute force, and the beam is doubled until the search finds ``AUDIT`` of them. A
shard whose audit still fails at a beam of ``WIDEST`` is searched by brute force, so no failed audit is ever accepted.

A pair is linked if the search for its smaller id finds it and its cosine in double precision is high enough. Both ends count
it: a task sums what each entry gets from its searches, so a dense group gives a row for each entry and task, not one for
each pair. For components a search gives one link to each connected group it meets in a shard.

Defined results: vectors that are null or zero or hold null, NaN or infinite components link with nothing, nor do
vectors of different lengths; rows without an id get a row without links; rows of one id count as vectors each and share a component if they
link; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.components import components, roots
from quern.llm.shared import fresh, load_arrays, save_arrays, stored
from quern.llm.topk import usable

#: Links of a node either way, candidates for them, the beams of building and searching, recall asked, audited entries.
LINKS, NEAREST, BUILD, BEAM, WIDEST, AUDIT, SAMPLE = 12, 40, 48, 16, 512, 0.98, 192
#: Entries of one shard, at most, about, and the least number of shards.
SHARD, SHARDS = 16_384, 8
#: Copies that make an entry hot, and the most of such entries that are broadcast.
COPIES, HOT = 1000, 10_000


def unit(vectors: np.ndarray) -> np.ndarray:
    v = np.asarray(vectors, np.float64)
    top = np.abs(v).max(1, keepdims=True)
    v = v / top  # so that no square over- or underflows
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def beam_search(q: np.ndarray, vectors: np.ndarray, links: np.ndarray, start: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and similarities of each query's beam (-1 and -2 where it is not full)."""
    n, rows = len(q), np.arange(len(q))
    nodes, sims = np.full((n, beam), -1), np.full((n, beam), -2, np.float32)
    done = np.ones((n, beam), bool)
    nodes[:, 0] = start
    sims[:, 0] = np.einsum("ij,ij->i", q, vectors[start])
    done[:, 0] = False
    seen = np.zeros((n, len(vectors)), bool)
    seen[rows, start] = True
    live = rows
    while len(live):
        s = np.where(done[live], np.float32(-3), sims[live])
        k = s.argmax(1)
        go = s[np.arange(len(live)), k] > -2.5
        live, k = live[go], k[go]
        if not len(live):
            break
        done[live, k] = True
        near = links[nodes[live, k]]
        new = (near >= 0) & ~seen[live[:, None], np.maximum(near, 0)]
        r, c = np.nonzero(new)
        node = near[r, c]
        seen[live[r], node] = True
        s = np.full(near.shape, -2, np.float32)
        s[r, c] = np.einsum("ij,ij->i", q[live[r]], vectors[node])
        all_s = np.concatenate([sims[live], s], axis=1)
        all_n = np.concatenate([nodes[live], np.where(new, near, -1)], axis=1)
        all_d = np.concatenate([done[live], ~new], axis=1)
        top = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
        take = lambda x: np.take_along_axis(x, top, axis=1)
        nodes[live], sims[live], done[live] = take(all_n), take(all_s), take(all_d)
    return nodes, sims


def descended(q: np.ndarray, vectors: np.ndarray, layers: list[np.ndarray]) -> np.ndarray:
    """A start below ``layers`` (the top one last) for each query, by greedy steps."""
    at = np.zeros(len(q), np.int64)
    sim = q @ vectors[0] if len(q) else np.zeros(0, np.float32)
    for links in reversed(layers):
        live = np.arange(len(q))
        while len(live):
            near = links[at[live]]
            s = np.einsum("ij,ikj->ik", q[live], vectors[np.maximum(near, 0)])
            s[near < 0] = -2
            k = s.argmax(1)
            row = np.arange(len(live))
            better = s[row, k] > sim[live]
            live, node, s = live[better], near[row, k][better], s[row, k][better]
            at[live], sim[live] = node, s
    return at


def picked(x: np.ndarray, nodes: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidate nodes ``most`` that are nearer to it than to one taken before, filled up with the nearest others."""
    out = np.full((len(nodes), most), -1)
    for a in range(0, len(nodes), 512):
        c, s = nodes[a : a + 512], sims[a : a + 512]
        order = np.argsort(-s, axis=1, kind="stable")[:, :NEAREST]
        c, s = np.take_along_axis(c, order, axis=1), np.take_along_axis(s, order, axis=1)
        v = x[np.maximum(c, 0)]
        pair = v @ v.transpose(0, 2, 1)
        taken = np.zeros(c.shape, bool)
        number = np.zeros(len(s), np.int64)
        for j in range(c.shape[1]):
            ok = (s[:, j] > np.where(taken, pair[:, :, j], -3).max(1)) & (number < most) & (c[:, j] >= 0)
            taken[:, j] = ok
            number += ok
        rank = np.where(taken, 0, np.where(c >= 0, 1, 2)) * c.shape[1] + np.arange(c.shape[1])
        by = np.argsort(rank, axis=1)[:, :most]
        out[a : a + len(c), : by.shape[1]] = np.take_along_axis(c, by, axis=1)
    return out


def layer_built(x: np.ndarray, upper: list[np.ndarray], most: int, first: int = 64) -> np.ndarray:
    """Links (-1 where there is none) of the nodes ``x``: ``most`` chosen ones, ``most`` back and a few spare ones that make all reachable."""
    n, spare = len(x), 4
    links, back = np.full((n, 2 * most + spare), -1), np.full((n, most), -3, np.float32)
    a = 0
    while a < n:
        b = min(n, a + max(first, a // 4))
        q = x[a:b]
        own = q @ q.T
        np.fill_diagonal(own, -3)
        k = min(NEAREST, b - a)
        nodes = np.argpartition(-own, k - 1, axis=1)[:, :k]
        sims = np.take_along_axis(own, nodes, axis=1)
        nodes = np.where(sims > -2.5, a + nodes, -1)
        if a:
            start = descended(q, x, upper)
            found, near = beam_search(q, x[:a], links[:a], np.where(start < a, start, 0), min(BUILD, 2 * a))
            nodes, sims = np.concatenate([found, nodes], axis=1), np.concatenate([near, sims], axis=1)
        chosen = picked(x, nodes, np.where(nodes >= 0, sims, -3), most)
        links[a:b, :most] = chosen
        # back links: of each node's, old and new, the nearest stay
        frm, to = np.repeat(np.arange(a, b), most), chosen.ravel()
        frm, to = frm[to >= 0], to[to >= 0]
        mutual = (links[to, :most] == frm[:, None]).any(1)
        frm, to = frm[~mutual], to[~mutual]
        some = np.unique(to)
        old_to, old = np.repeat(some, most), links[some, most : 2 * most].ravel()
        old_sim = back[some].ravel()
        had = old >= 0
        to, frm, sim = np.concatenate([to, old_to[had]]), np.concatenate([frm, old[had]]), np.concatenate([np.einsum("ij,ij->i", x[to], x[frm]), old_sim[had]])
        order = np.lexsort((frm, -sim, to))
        to, frm, sim = to[order], frm[order], sim[order]
        new = np.flatnonzero(np.r_[True, to[1:] != to[:-1]][: len(to)])
        place = np.arange(len(to)) - np.repeat(new, np.diff(np.append(new, len(to))))
        fits = place < most
        links[to[fits], most + place[fits]], back[to[fits], place[fits]] = frm[fits], sim[fits]
        a = b
    _reached(links, most)
    return links


def _reached(links: np.ndarray, most: int) -> None:
    """Give nodes that no path from node 0 leads to a spare link from one that has a path, as far as there is room."""
    seen = np.zeros(len(links), bool)
    front = np.zeros(min(1, len(links)), np.int64)
    while True:
        while len(front):
            seen[front] = True
            front = np.unique(links[front])
            front = front[front >= 0]
            front = front[~seen[front]]
        lost = np.flatnonzero(~seen)
        to = links[lost, :most]
        can = (to >= 0) & seen[to] & (links[to, -1] < 0)
        lost, to = lost[can.any(1)], to[can.any(1)]
        if not len(lost):
            return
        by = to[np.arange(len(lost)), can[can.any(1)].argmax(1)]
        by, one = np.unique(by, return_index=True)  # one for each at a time
        links[by, 2 * most + (links[by, 2 * most :] >= 0).sum(1)] = lost[one]
        front = lost[one]


class Graph:
    """Unit vectors with their layered links; -1 pads a node's links. With a beam of 0 it is searched by brute force."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray, exact: np.ndarray, vectors: np.ndarray, layers: list[np.ndarray], beam: int, group: np.ndarray):
        self.ids, self.copies, self.exact, self.vectors, self.layers, self.beam, self.group = ids, copies, exact, vectors, layers, beam, group

    @classmethod
    def built(cls, ids: np.ndarray, copies: np.ndarray, vectors: np.ndarray, least: float, asked: np.ndarray | None = None) -> Graph:
        """``asked``: unit vectors of entries anywhere, for the audit."""
        from xxhash import xxh64_intdigest

        u = np.array([(xxh64_intdigest(int(i).to_bytes(8, "little", signed=True)) + 1) / (1 << 64) for i in ids])
        order = np.lexsort((ids, u))
        ids, copies, exact, u = ids[order], copies[order], unit(vectors[order]), u[order]
        x = exact.astype(np.float32)
        level = np.floor(-np.log(np.clip(u, 1e-18, 1)) / np.log(LINKS)).astype(int)  # falls with the place
        layers: list[np.ndarray] = []
        for k in range(int(level.max()), -1, -1):
            n = int((level >= k).sum())
            if k == 0 or n > 1:
                layers.insert(0, layer_built(x[:n], layers, LINKS))
        g = cls(ids, copies, exact, x, layers, BEAM, np.arange(len(ids)))
        g.audit(least, asked)
        a, b, _ = g.search(exact, least)
        later = ids[b] > ids[a]
        g.group = roots(a[later], b[later], len(ids))
        return g

    def search(self, vectors: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, node, cosine) of every link found for unit ``vectors``, in double precision."""
        out_q, out_n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        block = max(64, min(2048, 40_000_000 // max(1, len(self.ids))))
        near = least - 1e-4
        for a in range(0, len(vectors), block):
            q = vectors[a : a + block].astype(np.float32)
            if not self.beam:
                r, n = np.nonzero(q @ self.vectors.T >= near)
                out_q.append(a + r)
                out_n.append(n)
                continue
            nodes, sims = beam_search(q, self.vectors, self.layers[0], descended(q, self.vectors, self.layers[1:]), self.beam)
            hit = sims >= near
            full = hit.sum(1) >= self.beam // 2
            r, c = np.nonzero(hit & ~full[:, None])
            out_q.append(a + r)
            out_n.append(nodes[r, c])
            for i in np.flatnonzero(full):
                found = self._follow(q[i], nodes[i][hit[i]], near)
                out_q.append(np.full(len(found), a + i))
                out_n.append(found)
        q, n = np.concatenate(out_q), np.concatenate(out_n)
        cos = np.concatenate([np.einsum("ij,ij->i", vectors[q[i : i + 65536]], self.exact[n[i : i + 65536]]) for i in range(0, len(q), 65536)]) if len(q) else np.zeros(0)
        keep = cos >= least
        return q[keep], n[keep], cos[keep]

    def _follow(self, q: np.ndarray, start: np.ndarray, near: float) -> np.ndarray:
        """Every node of similarity ``near`` that links from ``start`` lead to through such nodes."""
        links, seen = self.layers[0], np.zeros(len(self.ids), bool)
        seen[start] = True
        hits, front = [start], start
        while len(front):
            new = np.unique(links[front])
            new = new[new >= 0]
            new = new[~seen[new]]
            seen[new] = True
            front = new[self.vectors[new] @ q >= near]
            hits.append(front)
        return np.concatenate(hits)

    def audit(self, least: float, asked: np.ndarray | None = None) -> None:
        """Double the beam until the search finds the links that brute force finds for samples; beyond ``WIDEST`` search by brute force.

        The samples are entries of the graph, entries of the whole table, and vectors made for the purpose, each just
        near enough to an entry to be linked with it.
        """
        n = len(self.ids)
        rng = np.random.default_rng(n)
        some = rng.permutation(n)[:SAMPLE]
        near = self.exact[some]
        if near.shape[1] > 1:
            off = rng.normal(size=near.shape)
            off -= np.einsum("ij,ij->i", off, near)[:, None] * near
            cos = min(1.0, least + 0.01)
            near = cos * near + np.sqrt(1 - cos * cos) * off / np.maximum(np.sqrt((off * off).sum(1, keepdims=True)), 1e-30)
        v = np.concatenate([self.exact[some], near, *([] if asked is None else [asked])])
        own = np.full(len(v), -1)
        own[: len(some)] = some
        sims = v @ self.exact.T
        sims[np.arange(len(some)), some] = -2  # an entry's match with itself proves nothing
        true = {(i, j) for i, j in zip(*np.nonzero(sims >= least))}
        while self.beam:
            q, node, _ = self.search(v, least)
            other = own[q] != node
            if len(true & set(zip(q[other].tolist(), node[other].tolist()))) >= AUDIT * len(true):
                return
            self.beam = 2 * self.beam if self.beam < min(WIDEST, n) else 0

    def save(self, uri: str) -> None:
        parts = {"ids": self.ids, "copies": self.copies, "exact": self.exact.ravel(), "vectors": self.vectors.ravel(), "group": self.group, "beam": np.array([self.beam]), "layers": np.array([len(x) for x in self.layers])}
        save_arrays(uri, parts | {f"links{k}": links.ravel() for k, links in enumerate(self.layers)})

    @staticmethod
    @functools.lru_cache(maxsize=2)
    def mapped(uri: str) -> Graph:
        x = load_arrays(uri)
        n = len(x["ids"])
        layers = [x[f"links{k}"].reshape(m, -1) for k, m in enumerate(x["layers"].tolist())]
        return Graph(x["ids"], x["copies"], x["exact"].reshape(n, -1), x["vectors"].reshape(n, -1), layers, int(x["beam"][0]), x["group"])


def links_found(vectors: DataFrame, least: float, shard: int = SHARD, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """The entries (embedding, rep, copies), and what the searches found: (a, n) counts for ``b`` null, links (a, b) for ``n`` null."""
    spark = vectors.sparkSession
    good = vectors.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")) & F.exists("embedding", lambda x: x != 0)).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    entries = stored(good.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "entries")
    n = entries.count()
    of = max(shards, -(-n // shard))
    entries = entries.withColumn("dims", F.size("embedding")).withColumn("shard", F.pmod(F.xxhash64("rep"), F.lit(of)).cast("int"))
    folder = fresh(spark, "graphs")
    cols = ["rep", "copies", "embedding", "dims", "shard"]

    def matrix(t: pa.Table) -> np.ndarray:
        return np.concatenate([c.flatten().to_numpy() for c in t.column("embedding").chunks]).reshape(t.num_rows, -1)

    # at most SAMPLE entries of each length, of all shards, that every audit asks for
    share = min(1.0, 2 * SAMPLE / max(1, n)) * (1 << 30)
    first = Window.partitionBy("dims").orderBy("_hash")
    asked = entries.withColumn("_hash", F.pmod(F.xxhash64("rep", F.lit(3)), F.lit(1 << 30))).filter(F.col("_hash") <= share).withColumn("_rank", F.row_number().over(first))
    asked = asked.filter(F.col("_rank") <= SAMPLE).orderBy("dims", "_rank").limit(64 * SAMPLE).select(*cols).toArrow()

    def build(t: pa.Table) -> pa.Table:
        import uuid

        dims, number = t.column("dims")[0].as_py(), t.column("shard")[0].as_py()
        other = np.flatnonzero((asked.column("dims").to_numpy() == dims) & (asked.column("shard").to_numpy() != number))
        g = Graph.built(t.column("rep").to_numpy(), t.column("copies").to_numpy(), matrix(t), least, unit(matrix(asked.take(other))) if len(other) else None)
        uri = f"{folder}/{uuid.uuid4().hex}.arrow"
        g.save(uri)
        return pa.table([pa.array([number], pa.int32()), pa.array([dims], pa.int32()), pa.array([uri])], ["shard", "dims", "uri"])

    graphs = [tuple(r) for r in entries.select(*cols).groupBy("shard", "dims").applyInArrow(build, "shard int, dims int, uri string").collect()]  # one row for each graph

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in batches:
            t = pa.Table.from_batches([batch])
            reps, copies, size = (t.column(c).to_numpy() for c in ("rep", "copies", "dims"))
            for dims in np.unique(size).tolist():
                here = size == dims
                own, of, v = reps[here], t.column("shard").to_numpy()[here], unit(matrix(t.filter(pa.array(here))))
                for number, d, uri in graphs:
                    if d != dims:
                        continue
                    g = Graph.mapped(uri)
                    mine, order = own[of == number], np.argsort(g.ids)
                    yield told(mine, g.ids[g.group[order[np.searchsorted(g.ids[order], mine)]]], None)
                    q, node, _ = g.search(v, least)
                    later = g.ids[node] > own[q]
                    q, node = q[later], node[later]
                    both = np.concatenate([own[q], g.ids[node]]), np.concatenate([g.copies[node], copies[here][q]])
                    ends, at = np.unique(both[0], return_inverse=True)
                    for end, k in zip(ends.tolist(), np.bincount(at, weights=both[1]).astype(np.int64).tolist(), strict=True):
                        total[end] = total.get(end, 0) + k
                    pairs = np.unique(np.stack([q, g.group[node]]), axis=1)
                    yield told(own[pairs[0]], g.ids[pairs[1]], None)
            if len(total) > 1 << 20:
                yield told(np.array(list(total), np.int64), None, np.array(list(total.values()), np.int64))
                total = {}
        yield told(np.array(list(total), np.int64), None, np.array(list(total.values()), np.int64))

    def told(a: np.ndarray, b: np.ndarray | None, n: np.ndarray | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()) if x is None else pa.array(x, pa.int64()) for x in (a, b, n)], ["a", "b", "n"])

    tasks = max(min(32, -(-n // 512)), -(-n // shard))
    return entries, stored(entries.select(*cols).repartition(max(1, tasks), "rep").mapInArrow(seek, "a long, b long, n long"), "vector-links")


def near_duplicates(vectors: DataFrame, least: float = 0.9, shard: int = SHARD, shards: int = SHARDS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    entries, found = links_found(vectors, least, shard, shards)
    counts = found.filter("n IS NOT NULL").groupBy("a").agg(F.sum("n").alias("others"))
    linked_ = components(found.filter("b IS NOT NULL AND a <> b").select("a", "b"))
    of = entries.join(counts, F.col("rep") == F.col("a"), "left").join(linked_, F.col("rep") == F.col("node"), "left")
    of = stored(of.select(F.col("embedding").alias("e"), "copies", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("root", "rep").alias("root")), "entry-links")
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).withColumn("embedding", F.when(F.col("vec_id").isNotNull() & usable(F.col("embedding")), F.col("embedding")))
    # the entries with many copies are few, n / COPIES at most: broadcast, so that their rows need not meet in one task
    hot = of.filter(F.col("copies") > COPIES)
    if 0 < hot.count() <= HOT:
        many = F.broadcast(hot.select(F.col("e").alias("h"), F.col("links").alias("h_links"), F.col("root").alias("h_root")))
        rows = rows.join(many, F.col("embedding") == F.col("h"), "left").withColumn("embedding", F.when(F.col("h").isNull(), F.col("embedding"))).drop("h")
    else:
        rows = rows.withColumn("h_links", F.lit(None).cast("long")).withColumn("h_root", F.lit(None).cast("long"))
    out = rows.join(of, F.col("embedding") == F.col("e"), "left").select("vec_id", F.coalesce("h_links", "links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("h_root", "root", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
