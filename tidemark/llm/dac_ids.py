"""Token ids in files of directly addressable codes.

Ids are cut into chunks of ``CHUNK_BITS`` bits.  Level 0 holds every id's lowest chunk; a
level's bitmap marks the ids that go on, and the next level holds the next chunk of just
those, in order.  A directory of running counts every 512 bits gives ``rank`` in constant
time, so the place of an id's chunk in the next level follows from its place in this
one: any token is read with one step for each chunk, without decoding a block.

A file is one row of a Parquet dataset (``segment``: a header, then for each level its chunk
bytes, bitmap and rank directory); any store that Spark reads will do.  Segments hold whole
documents in ascending order; the few numbers that place them are columns, so a reader finds
a document's segment by a pushed-down filter and decodes no other.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows, pick, to_batch
from ..session import scratch_path, ship_package
from .token_cache import encoder

CHUNK_BITS = 8
#: Bits that one entry of a rank directory covers.
RANK_BITS = 512
#: Tokens after which a segment is closed (a longer document is a segment of its own).
SEGMENT_TOKENS = 1 << 20
MAGIC = b"DAC1"

_SEGMENT = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()),
                      ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("docs", pa.binary()), ("segment", pa.binary())])
_SEGMENT_SQL = ("part int, seq int, n_docs long, n_ids long, first_doc long, last_doc long, "
                "docs binary, segment binary")
_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])


def dac_encode(ids: np.ndarray) -> bytes:
    """The bytes of one segment: magic, count, levels, then (chunks, bitmap, directory) per level."""
    rest, levels = np.asarray(ids, dtype=np.uint32), []
    while True:
        low = (rest & np.uint32((1 << CHUNK_BITS) - 1)).astype(np.uint8)
        on = rest >= (1 << CHUNK_BITS)
        bitmap = np.packbits(on, bitorder="little")
        per = np.add.reduceat(on, np.arange(0, len(on), RANK_BITS), dtype=np.int64) if len(on) else np.zeros(0, np.int64)
        directory = np.concatenate([[0], np.cumsum(per)])[:-1].astype("<u4") if len(on) else np.zeros(0, "<u4")
        levels.append((low.tobytes(), bitmap.tobytes(), directory.tobytes()))
        if not on.any():
            break
        rest = rest[on] >> np.uint32(CHUNK_BITS)
    head = MAGIC + struct.pack("<QB", len(ids), len(levels))
    sizes = b"".join(struct.pack("<QQQ", *map(len, lv)) for lv in levels)
    return head + sizes + b"".join(part for lv in levels for part in lv)


class DacReader:
    """Random access into one segment's bytes."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        self.n, n_levels = struct.unpack_from("<QB", data, 4)
        at, self.levels = 13 + 24 * n_levels, []
        for k in range(n_levels):
            sizes = struct.unpack_from("<QQQ", data, 13 + 24 * k)
            cut = []
            for size, kind in zip(sizes, (np.uint8, np.uint8, np.dtype("<u4"))):
                cut.append(np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at))
                at += size
            self.levels.append(tuple(cut))

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k, (chunks, bitmap, directory) in enumerate(self.levels):
            value |= int(chunks[i]) << (CHUNK_BITS * k)
            if not bitmap[i >> 3] >> (i & 7) & 1:
                break
            i = self._rank(bitmap, directory, i)
        return value

    @staticmethod
    def _rank(bitmap, directory, i: int) -> int:
        """How many of the bits before i are set."""
        block = i // RANK_BITS
        first = block * RANK_BITS
        word = int.from_bytes(bitmap[first >> 3:(i >> 3) + 1].tobytes(), "little") & ((1 << (i - first)) - 1)
        return int(directory[block]) + word.bit_count()

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Ids start..stop-1, each level cut by rank at both ends."""
        start, stop = max(0, start), min(stop, self.n)
        if stop <= start:
            return np.zeros(0, np.uint32)
        out, where = np.zeros(stop - start, np.uint32), None
        for k, (chunks, bitmap, directory) in enumerate(self.levels):
            part = chunks[start:stop].astype(np.uint32) << np.uint32(CHUNK_BITS * k)
            if where is None:
                out |= part
            else:
                out[where] |= part
            bits = np.unpackbits(bitmap[start >> 3:(stop + 7) >> 3], bitorder="little")
            on = np.flatnonzero(bits[start & 7:(start & 7) + stop - start])
            if not len(on):
                break
            where = on if where is None else where[on]
            start = self._rank(bitmap, directory, start)
            stop = start + len(on)
        return out


def write_token_files(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 0,
                      partitions: int | None = None) -> None:
    """Encode every document, append ``end_id``, and write segments in ascending doc_id order.

    Texts are dealt by ranges of doc_id and sorted there, then encoded once, in the task that
    writes them.  Null text is empty; null doc ids come first; equal ids stay in the order of
    their texts; an empty table writes an empty dataset.
    """
    end = np.array([end_id], "<u4").tobytes()
    ship_package(docs.sparkSession)

    def run(batches):
        enc, part, seq = encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        ids: list[bytes] = []
        keys: list = []
        size = 0

        def close():
            data = b"".join(ids)
            lengths = np.fromiter((len(x) // 4 for x in ids), "<u4", len(ids)).tobytes()
            known = np.fromiter((k is not None for k in keys), np.uint8, len(keys)).tobytes()
            docs_ = np.fromiter((k or 0 for k in keys), "<i8", len(keys)).tobytes()
            return to_batch([(part, seq, len(ids), len(data) // 4, keys[0], keys[-1],
                              docs_ + lengths + known, dac_encode(np.frombuffer(data, "<u4")))], _SEGMENT)

        for b in (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000)):
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = enc.encode(text) + end
                if ids and size + len(x) > 4 * SEGMENT_TOKENS:
                    yield close()
                    ids, keys, size, seq = [], [], 0, seq + 1
                ids.append(x)
                keys.append(doc)
                size += len(x)
        if ids:
            yield close()

    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = [partitions] if partitions else []
    rows.repartitionByRange(*n, "doc_id").sortWithinPartitions("doc_id", "text") \
        .mapInArrow(run, _SEGMENT_SQL).write.mode("errorifexists").parquet(path)


def segment_starts(files: DataFrame) -> DataFrame:
    """part, seq, first: the ids before each segment.

    Tasks' totals (one small row for each) are summed on the driver; inside a task's
    segments a window does it.
    """
    sizes = files.select("part", "seq", "n_ids")
    totals = sorted((r.part, r.n) for r in sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    before, rows = 0, []
    for part, n in totals:
        rows.append((part, before))
        before += n
    base = files.sparkSession.createDataFrame(rows, "part int, base long")
    w = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    inside = sizes.withColumn("inside", F.coalesce(F.sum("n_ids").over(w), F.lit(0)))
    return inside.join(base, "part").select("part", "seq", (F.col("base") + F.col("inside")).alias("first"))


def read_token_files(files: DataFrame) -> DataFrame:
    """doc_id, start, ids (little-endian unsigned 32 bit) of every document, decoded from the files."""
    rows = files.join(segment_starts(files), ["part", "seq"]).select("first", "n_docs", "docs", "segment")

    def make():
        def run(cols):
            for first, n, docs_, segment in zip(*cols):
                reader = DacReader(segment)
                ids = reader.slice(0, len(reader)).astype("<u4").tobytes()
                keys = np.frombuffer(docs_, "<i8", n).tolist()
                lengths = np.frombuffer(docs_, "<u4", n, 8 * n).tolist()
                known = docs_[12 * n:]
                at = 0
                for key, length, k in zip(keys, lengths, known):
                    yield key if k else None, first + at, ids[4 * at:4 * (at + length)]
                    at += length
        return run

    return map_rows(rows, make, _DOCS, "doc_id long, start long, ids binary", weigh=lambda r: 64 + len(r[2]))


def token_file_round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """Write to the shared scratch folder, then read every document back from the files."""
    spark = docs.sparkSession
    path = scratch_path(spark, "token-ids")
    write_token_files(docs, tokenizer_path, path, end_id)
    return read_token_files(spark.read.schema(_SEGMENT_SQL).parquet(path))
