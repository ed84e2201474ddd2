"""Approximate nearest neighbours by inner product: a navigable small-world graph per shard.

Each shard holds a hierarchical graph over its vectors, stored as flat neighbour arrays (one
int32 matrix per level, -1 for a free place).  A vector gets one more component that makes all
lengths in the shard equal, so the largest inner product is also the nearest vector and the
graph's rules hold; a query gets 0 there, which leaves its inner products as they are.

Vectors enter in batches: a batch searches the graph from the top level down, keeps neighbours
by the diversity rule (a candidate nearer to a kept neighbour than to the vector is passed
over while others are left), and is linked back, full lists being thinned by the same rule.
Searches run for many queries at once, step by step, in array operations.

Every row is indexed; the search is approximate only in what a beam of ``ef`` misses in
a shard.  Vectors that are null, zero, or hold null or non-finite components take no part; an
empty table gives no row; see ``vectors`` for repeated vectors and ties.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import to_batch
from ..session import scratch_path, ship_package
from . import vectors as V

#: Links of a node on upper levels (twice as many on level 0), beams, rows of a shard and a query block.
LINKS = 16
EF_BUILD = 80
EF_SEARCH = 96
SHARD_ROWS = 4096
BLOCK_ROWS = 1024
_BATCH = 128
_WIDE = 4        # nodes that a search opens in one step

_INDEX = pa.schema([("dim", pa.int32()), ("shard", pa.int64()), ("n", pa.int64()), ("vectors", pa.binary()),
                    ("ids", pa.binary()), ("id_ends", pa.binary()), ("nodes", pa.list_(pa.binary())),
                    ("neighbours", pa.list_(pa.binary()))])
_INDEX_SQL = ("dim int, shard long, n long, vectors binary, ids binary, id_ends binary, "
              "nodes array<binary>, neighbours array<binary>")


class Graph:
    """Levels of flat neighbour arrays over equal-length vectors ``x``."""

    def __init__(self, x: np.ndarray, links: int = LINKS):
        self.x, self.links = x, links
        self.rows: list[np.ndarray] = []      # per level: node -> row of its matrix, -1 if absent
        self.near: list[np.ndarray] = []      # per level: [nodes, places], node numbers or -1

    def places(self, level: int) -> int:
        return self.links * (2 if level == 0 else 1)

    # -- search ---------------------------------------------------------------

    def beam(self, level: int, q: np.ndarray, start: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """Nodes and inner products [queries, ef] found on a level from ``start`` [queries, s]; -1 fills."""
        n_q = len(q)
        near, rows = self.near[level], self.rows[level]
        seen = np.zeros((n_q, len(self.x)), np.int32)
        node = np.full((n_q, ef), -1, np.int64)
        score = np.full((n_q, ef), -np.inf)
        opened = np.ones((n_q, ef), bool)
        self._take(q, np.arange(n_q), start, seen, node, score, opened, 0)
        live, step = np.arange(n_q), 1
        wide = min(_WIDE, ef)
        while len(live):
            s = np.where(opened[live], -np.inf, score[live])
            pick = np.argpartition(-s, wide - 1, axis=1)[:, :wide]
            fresh = np.take_along_axis(s, pick, 1) > -np.inf
            some = fresh.any(1)
            live, pick, fresh = live[some], pick[some], fresh[some]
            if not len(live):
                break
            opened[live[:, None], pick] = True
            at = np.where(fresh, node[live[:, None], pick], -1)
            nxt = np.where(at[..., None] >= 0, near[rows[at]], -1).reshape(len(live), -1)
            self._take(q, live, nxt, seen, node, score, opened, step)
            step += 1
        order = np.argsort(-score, axis=1, kind="stable")
        return np.take_along_axis(node, order, 1), np.take_along_axis(score, order, 1)

    def _take(self, q, live, new, seen, node, score, opened, step):
        """Let unseen nodes ``new`` [live, m] into the beams of the queries ``live``."""
        m, ef = new.shape[1], node.shape[1]
        safe = np.maximum(new, 0)
        ok = (new >= 0) & (seen[live[:, None], safe] == 0)
        r, c = np.nonzero(ok)
        mark = (step * 4096 + c + 1).astype(np.int32)
        seen[live[r], new[r, c]] = mark
        once = seen[live[r], new[r, c]] == mark        # of equal nodes in one step, one stays
        r, c = r[once], c[once]
        s = np.full((len(live), m), -np.inf)
        s[r, c] = np.einsum("ij,ij->i", self.x[new[r, c]], q[live[r]])
        all_score = np.concatenate([score[live], s], 1)
        all_node = np.concatenate([node[live], np.where(s > -np.inf, new, -1)], 1)
        all_open = np.concatenate([opened[live], s == -np.inf], 1)
        top = np.argpartition(-all_score, ef - 1, axis=1)[:, :ef]
        score[live] = np.take_along_axis(all_score, top, 1)
        node[live] = np.take_along_axis(all_node, top, 1)
        opened[live] = np.take_along_axis(all_open, top, 1)

    def descend(self, q: np.ndarray, to: int) -> np.ndarray:
        """Start nodes [queries, 1] on level ``to``, greedily from the top."""
        top = len(self.near) - 1
        at = np.full((len(q), 1), int(np.flatnonzero(self.rows[top] >= 0)[0]))
        for level in range(top, to, -1):
            at = self.beam(level, q, at, 1)[0]
        return at

    def search(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        return self.beam(0, q, self.descend(q, 0), ef)

    # -- building -------------------------------------------------------------

    def diverse(self, target: np.ndarray, cand: np.ndarray, places: int) -> np.ndarray:
        """Neighbours [targets, places] chosen from candidates [targets, c] by the diversity rule."""
        safe = np.maximum(cand, 0)
        score = np.where(cand >= 0, np.einsum("tcd,td->tc", self.x[safe], self.x[target]), -np.inf)
        order = np.argsort(-score, axis=1, kind="stable")
        cand, score = np.take_along_axis(cand, order, 1), np.take_along_axis(score, order, 1)
        xs = self.x[np.maximum(cand, 0)]
        among = np.matmul(xs, xs.transpose(0, 2, 1))
        kept = np.zeros(cand.shape, bool)
        for c in range(cand.shape[1]):
            covered = (kept & (among[:, c, :] > score[:, c, None])).any(1)
            kept[:, c] = (cand[:, c] >= 0) & ~covered & (kept.sum(1) < places)
        # free places go to the best of those passed over
        rank = np.where(cand >= 0, np.where(kept, 0, 1), 2) * cand.shape[1] + np.arange(cand.shape[1])
        first = np.argsort(rank, axis=1, kind="stable")[:, :places]
        out = np.take_along_axis(cand, first, 1)
        if out.shape[1] < places:
            out = np.pad(out, ((0, 0), (0, places - out.shape[1])), constant_values=-1)
        return out

    def link_back(self, level: int, node: np.ndarray, chosen: np.ndarray) -> None:
        """Put each node into the lists of the neighbours it chose."""
        near, rows, places = self.near[level], self.rows[level], self.places(level)
        r, c = np.nonzero(chosen >= 0)
        target, source = chosen[r, c], node[r]
        order = np.argsort(target, kind="stable")
        target, source = target[order], source[order]
        whom, first, many = np.unique(target, return_index=True, return_counts=True)
        new = np.full((len(whom), int(many.max()) if len(whom) else 0), -1, np.int64)
        new[np.repeat(np.arange(len(whom)), many), np.arange(len(target)) - np.repeat(first, many)] = source
        both = np.concatenate([near[rows[whom]], new], 1)
        short = (both >= 0).sum(1) <= places
        packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)[:, :places]
        near[rows[whom[short]]] = packed[short]
        if (~short).any():
            near[rows[whom[~short]]] = self.diverse(whom[~short], both[~short], places)

    def build(self, ef: int = EF_BUILD, seed: int = 0) -> Graph:
        n, rng = len(self.x), np.random.default_rng(seed)
        level_of = np.minimum(rng.exponential(1 / np.log(self.links), n).astype(np.int64), 8)
        for level in range(int(level_of.max(initial=0)) + 1):
            own = np.flatnonzero(level_of >= level)
            rows = np.full(n, -1, np.int64)
            rows[own] = np.arange(len(own))
            self.rows.append(rows)
            self.near.append(np.full((len(own), self.places(level)), -1, np.int64))
        # the highest nodes first: every later search starts from the top level
        order = np.argsort(-level_of, kind="stable")
        entry, done = order[:1], 1
        while done < n:
            batch = order[done:done + min(_BATCH, max(1, done // 2))]
            self._enter(batch, level_of, entry, ef)
            done += len(batch)
        return self

    def _enter(self, batch, level_of, entry, ef):
        q = self.x[batch]
        at = np.repeat(entry[None, :], len(batch), 0)
        for level in range(len(self.near) - 1, -1, -1):
            stays = level_of[batch] >= level
            found = at.copy()
            if (~stays).any():
                found[~stays] = self.beam(level, q[~stays], at[~stays], 1)[0]
            if stays.any():
                own, many = batch[stays], int(stays.sum())
                cand, _ = self.beam(level, q[stays], at[stays], ef)
                found[stays] = cand[:, :1]
                peers = np.where(~np.eye(many, dtype=bool), own[None, :], -1)
                if many > ef:
                    s = np.where(peers >= 0, q[stays] @ q[stays].T, -np.inf)
                    peers = np.take_along_axis(peers, np.argpartition(-s, ef, axis=1)[:, :ef], 1)
                both = np.concatenate([cand, peers], 1)
                if both.shape[1] > ef:
                    s = np.where(both >= 0, np.einsum("tcd,td->tc", self.x[np.maximum(both, 0)], q[stays]), -np.inf)
                    both = np.take_along_axis(both, np.argpartition(-s, ef - 1, axis=1)[:, :ef], 1)
                chosen = self.diverse(own, both, self.links)
                near, rows = self.near[level], self.rows[level]
                near[rows[own], :self.links] = chosen
                self.link_back(level, own, chosen)
            at = found


def equal_lengths(vec: np.ndarray) -> np.ndarray:
    """Vectors with one more component, so that all have the length of the longest."""
    square = np.einsum("ij,ij->i", vec, vec)
    return np.concatenate([vec, np.sqrt(np.maximum(square.max(initial=0) - square, 0))[:, None]], 1)


def build_index(vectors: DataFrame, links: int = LINKS, ef: int = EF_BUILD) -> DataFrame:
    """One row per shard (columns dim, shard, vec, ids in): vectors, ids and flat neighbour arrays."""
    ship_package(vectors.sparkSession)

    def build(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["vec"].to_pylist(), table["ids"].to_pylist()), key=lambda r: r[1])
        vec = np.array([v for v, _ in rows], np.float64)
        g = Graph(equal_lengths(vec), links).build(ef)
        ids, ends = V.pack_ids([i for _, i in rows])
        return pa.Table.from_batches([to_batch([(
            table["dim"][0].as_py(), table["shard"][0].as_py(), len(rows), vec.astype("<f8").tobytes(), ids, ends,
            [np.flatnonzero(r >= 0).astype("<i4").tobytes() for r in g.rows], [m.astype("<i4").tobytes() for m in g.near])], _INDEX)])

    return vectors.groupBy("dim", "shard").applyInArrow(build, _INDEX_SQL)


def load_graph(vec: np.ndarray, nodes: list[bytes], neighbours: list[bytes], links: int = LINKS) -> Graph:
    g = Graph(equal_lengths(vec), links)
    for level, (own, near) in enumerate(zip(nodes, neighbours)):
        own = np.frombuffer(own, "<i4")
        rows = np.full(len(vec), -1, np.int64)
        rows[own] = np.arange(len(own))
        g.rows.append(rows)
        g.near.append(np.frombuffer(near, "<i4").astype(np.int64).reshape(len(own), g.places(level)))
    return g


def search_index(index: DataFrame, blocks: DataFrame, k: int, links: int = LINKS, ef: int = EF_SEARCH) -> DataFrame:
    """Every query's k best of every shard: query_id, vec_id, score (inner product in double precision)."""
    def run(batches):
        held: tuple = (None, None)
        for b in batches:
            for r in b.to_pylist():
                vec = np.frombuffer(r["vectors"], "<f8").reshape(r["n"], r["dim"])
                if held[0] != (r["dim"], r["shard"]):
                    held = (r["dim"], r["shard"]), load_graph(vec, r["nodes"], r["neighbours"], links)
                ids, ends = V.unpack_ids(r["ids"], r["id_ends"])
                own = np.frombuffer(r["query_ids"], "<i8")
                q = np.frombuffer(r["query_vectors"], "<f8").reshape(len(own), r["dim"])
                out = []
                for at in range(0, len(own), 256):
                    part = q[at:at + 256]
                    node, _ = held[1].search(np.concatenate([part, np.zeros((len(part), 1))], 1), max(ef, k + 1))
                    for j in range(len(part)):
                        got = node[j][node[j] >= 0]
                        score = vec[got] @ part[j]
                        me = int(own[at + j])
                        out += [(me, i, s) for i, s in V.best_ids(got, score, ids, ends, me, k)]
                yield to_batch(out, V.HITS)

    return index.join(blocks, ["dim", "shard"]).mapInArrow(run, V.HITS_SQL)


def nearest_neighbours(table: DataFrame, is_query, k: int = 20, shard_rows: int = SHARD_ROWS,
                       block_rows: int = BLOCK_ROWS, ef: int = EF_SEARCH) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found among all other rows.

    ``is_query`` is a condition on vec_id.  Columns in: vec_id, embedding.
    """
    spark = table.sparkSession
    rows = V.rows_of(table, lambda e: V.finite(e) & F.exists(e, lambda x: x != 0), lambda e: e)
    vectors, shards = V.in_shards(V.distinct_vectors(rows, k), shard_rows)
    path = scratch_path(spark, "hnsw")
    build_index(vectors, LINKS).write.parquet(path)
    index = spark.read.schema(_INDEX_SQL).parquet(path)
    blocks = V.query_blocks(rows.where(is_query), shards, block_rows)
    return V.merge_hits(search_index(index, blocks, k, LINKS, ef), k)
