"""Exact top-k inner products of integer vectors by MaxScore.

Vectors are dealt to shards, and a shard's vectors to blocks of like ones (cut in halves at the
median of the dimension that varies most), so that a block's impacts are alike.  A block keeps a posting list for
each dimension: its vectors' components, in order, with their largest and smallest.  For a query, a list adds at
most |q| times its extreme component of the query's sign (nothing, if there is none), which is its bound.

A query visits blocks by descending sum of bounds and stops when the next sum is below its threshold, the k-th best
score so far.  In a block the lists are split: the non-essential ones are the longest run of
smallest bounds whose sum is below what the threshold needs, so a vector in none of the others can't reach it.
Essential lists are traversed for all queries at the block; the vectors that can still reach the
threshold with what the others may add are probed in those, largest bounds first, and dropped as soon as they can't.
The threshold rises from block to block, so more and more lists become non-essential.

The first shard of a dimension is searched for all queries; their thresholds go with them to all other shards.
Every (query block, shard) is a unit of work of bounded size.  Shards' results are merged by rank.

Scores are exact: products are summed as doubles where every sum stays below 2**53, and as whole numbers of any size
beyond; a score that a long can't hold raises.  Vectors that are null or hold null or non-finite components take no
part; zero vectors do; an empty table gives no row; see ``vectors`` for repeated vectors and ties.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import to_batch
from ..session import scratch_path, ship_package
from . import vectors as V

SHARD_ROWS = 8192
BLOCK_ROWS = 512
SCALE = 1024
#: Vectors of a block of a shard.
LIKE_ROWS = 256
#: Sums of products below this are exact as doubles.
_EXACT = 2.0 ** 53

_INDEX = pa.schema([("dim", pa.int32()), ("shard", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("id_ends", pa.binary()),
                    ("lists", pa.binary()), ("block_ends", pa.binary())])
_INDEX_SQL = "dim int, shard long, n long, ids binary, id_ends binary, lists binary, block_ends binary"
_QUERIES = pa.schema([("dim", pa.int32()), ("block", pa.int64()), ("query_ids", pa.binary()), ("query_vectors", pa.binary()),
                      ("thresholds", pa.binary())])
_QUERIES_SQL = "dim int, block long, query_ids binary, query_vectors binary, thresholds binary"


def like_blocks(x: np.ndarray, rows: int) -> list[np.ndarray]:
    """Row numbers of blocks of at most ``rows`` vectors each, cut at the median of the most varied dimension."""
    out, left = [], [np.arange(len(x))]
    while left:
        own = left.pop()
        if len(own) <= rows:
            out.append(own)
            continue
        part = x[own]
        d = int(np.argmax(part.std(0))) if x.shape[1] else 0
        half = len(own) // 2
        order = np.argpartition(part[:, d], half) if x.shape[1] else np.arange(len(own))
        left += [own[order[half:]], own[order[:half]]]
    return out


class Postings:
    """A shard's blocks: ``lists`` holds a row for each dimension, the blocks' components side by side."""

    def __init__(self, lists: np.ndarray, ends: np.ndarray, smallest_id: np.ndarray):
        self.lists, self.smallest_id = lists, smallest_id
        self.ends = [0, *ends.tolist()]
        cut = list(zip(self.ends, self.ends[1:]))
        size = (len(cut), len(lists))
        self.most = np.array([lists[:, a:b].max(1) for a, b in cut]).reshape(size)
        self.least = np.array([lists[:, a:b].min(1) for a, b in cut]).reshape(size)
        self.largest = float(np.abs(lists).max(initial=0.0))

    def top(self, q: np.ndarray, k: int, threshold: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(rows, scores) of each query's k best that reach its threshold, ties to the smaller id."""
        if np.abs(q).sum(1).max(initial=0.0) * self.largest >= _EXACT:
            return [self._whole(v, k) for v in q]
        adds, takes = np.maximum(q, 0), np.maximum(-q, 0)
        # what a block's lists can add up to, of either sign
        reach = adds @ self.most.T - takes @ self.least.T
        order = np.argsort(-reach, axis=1, kind="stable")
        least = threshold.astype(np.float64).copy()
        rows = [np.zeros(0, np.int64)] * len(q)
        scores = [np.zeros(0)] * len(q)
        going = np.arange(len(q))
        for turn in range(order.shape[1]):
            block = order[going, turn]
            open_ = reach[going, block] >= least[going]
            going, block = going[open_], block[open_]
            if not len(going):
                break
            o = np.argsort(block, kind="stable")
            for b, own in zip(*_runs(block[o], going[o])):
                self._block(b, own, q[own], adds[own], takes[own], k, least, rows, scores)
        return list(zip(rows, scores))

    def _block(self, b: int, own: np.ndarray, q, adds, takes, k: int, least: np.ndarray, rows: list, scores: list) -> None:
        """Searches a block for some queries, and raises their thresholds."""
        first, last = self.ends[b], self.ends[b + 1]
        lists = self.lists[:, first:last]
        bound = np.maximum(adds * self.most[b] - takes * self.least[b], 0.0)
        by_size = np.argsort(bound, axis=1, kind="stable")
        below = np.cumsum(np.take_along_axis(bound, by_size, 1), axis=1)
        free = (below < least[own, None]).sum(1)
        place = np.empty_like(by_size)
        np.put_along_axis(place, by_size, np.arange(bound.shape[1])[None, :], 1)
        essential = place >= free[:, None]
        got = np.where(essential, q, 0.0) @ lists
        spare = np.where(free > 0, below[np.arange(len(own)), np.maximum(free - 1, 0)], 0.0)
        who, row = np.nonzero(got + spare[:, None] >= least[own, None])
        score = got[who, row]
        if free.any():
            # probes, the larger half of the bounds first
            half = free // 2
            for low, high in ((half, free), (np.zeros_like(half), half)):
                part = np.where((place >= low[:, None]) & (place < high[:, None]), q, 0.0)
                score = score + np.einsum("ij,ij->i", part[who], lists.T[row])
                left = np.where(low > 0, below[np.arange(len(own)), np.maximum(low - 1, 0)], 0.0)
                keep = score + left[who] >= least[own[who]]
                who, row, score = who[keep], row[keep], score[keep]
        for i, mine in zip(*_runs(who, np.arange(len(who)))):
            me = own[i]
            r = np.concatenate([rows[me], row[mine] + first])
            s = np.concatenate([scores[me], score[mine]])
            if len(r) > k:
                best = np.lexsort((self.smallest_id[r], -s))[:k]
                r, s = r[best], s[best]
                least[me] = max(least[me], s[-1])
            rows[me], scores[me] = r, s

    def _whole(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """As ``top`` for one query, in whole numbers of any size."""
        weight = [int(v) for v in q]
        score = [sum(w * int(v) for w, v in zip(weight, x) if w) for x in self.lists.T.tolist()]
        best = sorted(range(len(score)), key=lambda r: (-score[r], self.smallest_id[r]))[:k]
        return np.array(best, np.int64), np.array([score[r] for r in best], object)


def _runs(keys: np.ndarray, values: np.ndarray):
    """(keys, values of each) of sorted keys."""
    if not len(keys):
        return [], []
    cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    return keys[np.append(0, cut)].tolist(), np.split(values, cut)


def build_postings(vectors: DataFrame, like_rows: int = LIKE_ROWS) -> DataFrame:
    """One row per shard (columns dim, shard, vec, ids in): flat posting lists of its blocks."""
    ship_package(vectors.sparkSession)

    def build(table: pa.Table) -> pa.Table:
        vec, ids = table["vec"].to_pylist(), table["ids"].to_pylist()
        x = np.array(vec, np.float64).reshape(len(vec), -1)
        blocks = like_blocks(x, like_rows)
        order = np.concatenate(blocks)
        flat, ends = V.pack_ids([ids[i] for i in order.tolist()])
        return pa.Table.from_batches([to_batch([(
            table["dim"][0].as_py(), table["shard"][0].as_py(), len(vec), flat, ends, np.ascontiguousarray(x[order].T).astype("<f8").tobytes(),
            np.cumsum([len(b) for b in blocks], dtype=np.int64).astype("<i8").tobytes())], _INDEX)])

    return vectors.groupBy("dim", "shard").applyInArrow(build, _INDEX_SQL)


def pack_queries(queries: DataFrame, block_rows: int) -> DataFrame:
    """One row per (dimension, block) of queries (vec_id, vec, threshold: null if none yet)."""
    ship_package(queries.sparkSession)
    n = max(1, -(-queries.count() // block_rows))

    def packed(table: pa.Table) -> pa.Table:
        low = [np.nan if t is None else t for t in table["threshold"].to_pylist()]
        return pa.Table.from_batches([to_batch([(
            table["dim"][0].as_py(), table["block"][0].as_py(), np.array(table["vec_id"].to_pylist(), "<i8").tobytes(),
            np.array(table["vec"].to_pylist(), "<f8").tobytes(), np.array(low, "<f8").tobytes())], _QUERIES)])

    return queries.withColumn("dim", F.size("vec")).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n).cast("long"))) \
        .groupBy("dim", "block").applyInArrow(packed, _QUERIES_SQL)


def search_postings(index: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """Every query's k best of the shards it meets (blocks: shard in): query_id, vec_id, score."""
    def run(batches):
        held: tuple = (None, None)
        for b in batches:
            for at in range(b.num_rows):
                (r,) = b.slice(at, 1).to_pylist()
                ids, ends = V.unpack_ids(r["ids"], r["id_ends"])
                if held[0] != (r["dim"], r["shard"]):
                    held = (r["dim"], r["shard"]), Postings(
                        np.frombuffer(r["lists"], "<f8").reshape(r["dim"], r["n"]), np.frombuffer(r["block_ends"], "<i8"), ids[ends[:-1]])
                own = np.frombuffer(r["query_ids"], "<i8")
                q = np.frombuffer(r["query_vectors"], "<f8").reshape(len(own), r["dim"])
                low = np.frombuffer(r["thresholds"], "<f8")
                out = []
                # one more than k: the query's own vector may be among them
                found = held[1].top(q, k + 1, np.where(np.isnan(low), -np.inf, low))
                for me, (rows, score) in zip(own.tolist(), found):
                    out += [(me, i, s) for i, s in best_ids(rows.tolist(), score.tolist(), ids, ends, me, k)]
                yield to_batch(out, HITS)

    return index.join(blocks, ["dim", "shard"]).mapInArrow(run, HITS_SQL)


HITS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
HITS_SQL = "query_id long, vec_id long, score long"


def best_ids(rows: list, scores: list, ids: np.ndarray, ends: np.ndarray, own: int, k: int):
    """The k best (id, score) of some vectors' ids, without the query's own; ties to the smaller id."""
    got = sorted((-int(s), int(i)) for r, s in zip(rows, scores) for i in ids[ends[r]:ends[r + 1]] if i != own)[:k]
    if any(not -(1 << 63) <= -s < 1 << 63 for s, _ in got):
        raise OverflowError("a score doesn't fit into a long")
    return [(i, -s) for s, i in got]


def top_inner_products(table: DataFrame, is_query, k: int = 10, scale: int = SCALE, shard_rows: int = SHARD_ROWS,
                       block_rows: int = BLOCK_ROWS, like_rows: int = LIKE_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest inner products of floor(scale * x), exactly."""
    spark = table.sparkSession
    # from 2**52 on every double is whole
    whole = lambda e: F.transform(e, lambda x: F.when(F.abs(x * scale) < 2.0 ** 52, F.floor(x * scale).cast("double"))
                                  .otherwise(x * scale))
    rows = V.rows_of(table, V.finite, whole)
    vectors, shards = V.in_shards(V.distinct_vectors(rows, k), shard_rows)
    path = scratch_path(spark, "postings")
    build_postings(vectors, like_rows).write.parquet(path)
    index = spark.read.schema(_INDEX_SQL).parquet(path)
    queries = rows.where(is_query).where(F.size("vec").isin(list(shards)))
    # the first shard of each dimension is searched by all queries
    path = scratch_path(spark, "first-hits")
    start = pack_queries(queries.withColumn("threshold", F.lit(None).cast("double")), block_rows)
    search_postings(index.where("shard = 0"), start.withColumn("shard", F.lit(0).cast("long")), k).write.parquet(path)
    first = spark.read.schema(HITS_SQL).parquet(path)
    if max(shards.values(), default=0) <= 1:
        return V.merge_hits(first, k)
    # the k-th best score is what others must reach (a double may lie just above a large one)
    least = first.dropDuplicates().groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("low")).where(F.col("n") >= k) \
        .select(F.col("query_id").alias("vec_id"), (F.col("low") - 1).cast("double").alias("threshold"))
    rest = pack_queries(queries.join(least, "vec_id", "left"), block_rows)
    n = F.create_map(*[F.lit(x) for d, m in shards.items() for x in (d, m)])
    rest = rest.withColumn("shard", F.explode(F.when(n[F.col("dim")] > 1, F.sequence(F.lit(1), n[F.col("dim")] - 1)))) \
        .withColumn("shard", F.col("shard").cast("long"))
    return V.merge_hits(first.union(search_postings(index.where("shard > 0"), rest, k)), k)
