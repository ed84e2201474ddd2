"""What the two vector searches share: distinct vectors, shards, query blocks and the merge.

Candidates that hold the same vector are one candidate with a list of ids.  A result has k
entries, so of a vector's ids only the k + 1 smallest can ever be returned (one more for the
query itself): the others are left out by rank before the shuffle, which keeps results whole
and a vector that a third of the table holds cheap.

Vectors are dealt to shards of about ``shard_rows`` by hash, and queries to blocks.  A shard's
row meets each query block of its dimension in one join on the shard; every
(query, shard) gives its k best, and a rank over the query keeps the k best of all.

Vectors of another length than the query's aren't compared with it; a null id takes no part.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, to_batch
from ..session import scratch_path, ship_package

HITS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
HITS_SQL = "query_id long, vec_id long, score double"
_BLOCK = pa.schema([("dim", pa.int32()), ("block", pa.int64()), ("query_ids", pa.binary()), ("query_vectors", pa.binary())])
_BLOCK_SQL = "dim int, block long, query_ids binary, query_vectors binary"


def finite(v: Column) -> Column:
    """True for arrays without null, NaN or infinite components (false for a null array)."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad, F.lit(False))


def rows_of(df: DataFrame, keep: Callable[[Column], Column], value: Callable[[Column], Column]) -> DataFrame:
    """vec_id, vec (array<double>) of the rows that take part."""
    own = pick(df, "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"),
                                                 F.col("embedding").cast("array<double>").alias("e"))
    return own.where(F.col("vec_id").isNotNull() & keep(F.col("e"))).select("vec_id", value(F.col("e")).alias("vec"))


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """vec, dim, ids: every distinct vector with the k + 1 smallest ids that hold it."""
    w = Window.partitionBy("vec").orderBy("vec_id")
    few = rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1)
    return few.groupBy("vec").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")).withColumn("dim", F.size("vec"))


def in_shards(vectors: DataFrame, shard_rows: int) -> tuple[DataFrame, dict[int, int]]:
    """Adds shard; also the number of shards of each dimension."""
    path = scratch_path(vectors.sparkSession, "vectors")
    vectors.write.parquet(path)
    stored = vectors.sparkSession.read.schema(vectors.schema).parquet(path)
    n = {r.dim: -(-r.n // shard_rows) for r in stored.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    return stored.withColumn("shard", F.pmod(F.xxhash64("vec"), _by_dim(n, 1))), n


def _by_dim(n: dict[int, int], other: int) -> Column:
    out = F.lit(other).cast("long")
    for dim, k in n.items():
        out = F.when(F.col("dim") == dim, F.lit(k).cast("long")).otherwise(out)
    return out


def query_blocks(queries: DataFrame, shards: dict[int, int], block_rows: int) -> DataFrame:
    """One row per (dimension, block, shard): packed query ids and vectors, for every shard of the dimension."""
    ship_package(queries.sparkSession)
    sized = queries.withColumn("dim", F.size("vec")).where(F.col("dim").isin(list(shards)))
    n = -(-sized.count() // block_rows)

    def packed(table: pa.Table) -> pa.Table:
        ids = np.array(table["vec_id"].to_pylist(), "<i8")
        vec = np.array(table["vec"].to_pylist(), "<f8")
        return pa.Table.from_batches([to_batch([(table["dim"][0].as_py(), table["block"][0].as_py(), ids.tobytes(), vec.tobytes())], _BLOCK)])

    blocks = sized.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(max(n, 1)).cast("long"))) \
        .groupBy("dim", "block").applyInArrow(packed, _BLOCK_SQL)
    return blocks.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), _by_dim(shards, 1) - 1)))


def unpack_ids(flat: bytes, ends: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(flat, "<i8"), np.concatenate([[0], np.frombuffer(ends, "<i4")])


def pack_ids(ids: list[list[int]]) -> tuple[bytes, bytes]:
    return (np.array([i for x in ids for i in x], "<i8").tobytes(),
            np.cumsum([len(x) for x in ids], dtype=np.int64).astype("<i4").tobytes())


def best_ids(rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, ends: np.ndarray, own: int, k: int):
    """The k best (id, score) of some candidates' ids, without the query's own; ties to the smaller id."""
    got = [(-float(s), int(i)) for r, s in zip(rows, scores) for i in ids[ends[r]:ends[r + 1]] if i != own]
    return [(i, -s) for s, i in sorted(got)[:k]]


def merge_hits(hits: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all shards."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.dropDuplicates(["query_id", "vec_id", "score"]).withColumn("rank", F.row_number().over(w)) \
        .where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
