"""Removal of repeated byte strings, by suffix arrays of shards.

Every byte covered by a string of ``length`` bytes that also starts anywhere else goes; strings
are judged on the input and never cross documents.

1. Each window of ``length`` bytes is named by its anchor: the piece of ``PIECE`` bytes of smallest hash in
   it (of equal ones the leftmost).  Windows of one content have one anchor, wherever they
   are.  Neighbouring windows that share an anchor's place form a segment, so every window lies
   in exactly one segment, and a segment needs only its anchor's hash and its own to be known.
2. Segments are counted by hash.  All windows of a segment that occurs twice are repeated; a segment whose
   anchor no other one has holds none.  What is left are different segments with one anchor.
3. The texts of those, each once, are dealt to shards by anchor.  A shard's suffix array is built by
   induced sorting; a window is repeated where its permuted common prefix with a neighbour in the
   array reaches ``length``.  Segments are ended by a byte that no UTF-8 text has.
4. An anchor whose segments exceed half a shard isn't gathered: their windows are counted by hash instead,
   spread over all tasks.
5. The repeated windows of a text go back to it as byte ranges, which are joined and cut out.

Names of texts, segments and windows are 128-bit hashes.  Nothing is sent to the driver but one total.

Null text is empty; null and repeated ids are no matter, for texts are told by content; two rows of one
text of ``length`` bytes or more both go whole; other columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path, ship_package
from .common import FLUSH_BYTES, pick, to_batch
from .lm_score import mix
from .suffix_sort import permuted_common_prefixes, suffix_array

LENGTH = 400
#: Bytes of an anchor; shorter where windows are.
PIECE = 64
SHARD_BYTES = 2 << 20
#: Bytes hashed at once; a longer document is taken in pieces that overlap by a window.
_AT_ONCE = 1 << 20
_BITS = 21
#: Texts that a task remembers having handed on.
_REMEMBERED = 1 << 16
#: Ends a segment in a shard; UTF-8 has no such byte.
_END = b"\xff"

_SEGMENTS_SQL = "text_a long, text_b long, start long, windows int, anchor long, seg_a long, seg_b long"
_SEGMENTS = pa.schema([("text_a", pa.int64()), ("text_b", pa.int64()), ("start", pa.int64()), ("windows", pa.int32()),
                       ("anchor", pa.int64()), ("seg_a", pa.int64()), ("seg_b", pa.int64())])
_TEXTS_SQL = "anchor long, seg_a long, seg_b long, bytes binary"
_TEXTS = pa.schema([("anchor", pa.int64()), ("seg_a", pa.int64()), ("seg_b", pa.int64()), ("bytes", pa.binary())])
_RANGES_SQL = "seg_a long, seg_b long, first int, last int"
_RANGES = pa.schema([("seg_a", pa.int64()), ("seg_b", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])
_KEPT_SQL = "doc_id long, n_bytes long, n_spans long, kept binary"
_KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])


def text_name(text: Column) -> list[Column]:
    """The first 128 bits of a text's sha256, as two longs."""
    digest = F.sha2(text.cast("binary"), 256)
    half = lambda at: (F.shiftleft(F.conv(F.substring(digest, at, 8), 16, 10).cast("long"), 32)
                       .bitwiseOR(F.conv(F.substring(digest, at + 8, 8), 16, 10).cast("long")))
    return [half(1).alias("text_a"), half(17).alias("text_b")]


# -- windows, anchors, segments ----------------------------------------------------


class Anchors:
    """Segments of a run of bytes."""

    def __init__(self, length: int):
        self.length = length
        self.piece = max(1, min(PIECE, length // 2))
        n = _AT_ONCE + length
        odd = np.uint64(0x9E3779B97F4A7C15)
        inverse = np.uint64(pow(int(odd), -1, 1 << 64))
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.full(n, odd))
            self.back = np.cumprod(np.full(n, inverse))

    def segments(self, data: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, windows, anchor hash) of the segments of the windows that begin where ``valid`` holds."""
        n, k = len(data), self.piece
        width = self.length - k + 1
        with np.errstate(over="ignore"):
            total = np.zeros(n + 1, np.uint64)
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[:n], out=total[1:])
            hashes = mix((total[k:] - total[:-k]) * self.back[:n - k + 1])
        # smallest hash, leftmost place: the place sits in the low bits
        low = np.uint64((1 << _BITS) - 1)
        key = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
        rows = -(-len(key) // width)
        grid = np.full(rows * width, np.uint64(0xFFFFFFFFFFFFFFFF))
        grid[:len(key)] = key
        grid = grid.reshape(rows, width)
        head = np.minimum.accumulate(grid, axis=1).ravel()
        tail = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        m = len(valid)
        place = (np.minimum(tail[:m], head[width - 1:width - 1 + m]) & low).astype(np.int64)
        new = valid.copy()
        new[1:] &= ~valid[:-1] | (place[1:] != place[:-1])
        start = np.flatnonzero(new)
        ends = np.flatnonzero(valid & ~np.append(valid[1:] & ~new[1:], False))
        return start, ends - start + 1, hashes[place[start]]


def _pieces(offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, int, int]]:
    """(first row, last row + 1, first byte, last byte) of bytes to be hashed at once."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + _AT_ONCE, "right")) - 1)
        a, b = int(offsets[first]), int(offsets[last])
        if b - a <= _AT_ONCE:
            yield first, last, a, b
        else:
            for at in range(a, max(a + 1, b - length + 1), _AT_ONCE):
                yield first, last, at, min(b, at + _AT_ONCE + length - 1)
        first = last


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def segment_table(docs: DataFrame, length: int) -> DataFrame:
    """Every segment of every text (text_a, text_b, text): its text, start, windows, anchor and hash."""
    def run(batches):
        anchors = Anchors(length)
        over = length - 1
        for b in batches:
            col = b.column(2).cast(pa.large_binary())
            offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
            data = np.frombuffer(col.buffers()[2], np.uint8)
            names = [np.asarray(b.column(i)) for i in (0, 1)]
            for first, last, a, z in _pieces(offsets, length):
                if z - a < length:
                    continue
                own = data[a:z]
                valid = np.ones(z - a - over, bool)
                for e in offsets[first + 1:last].tolist():
                    valid[max(0, e - a - over):e - a] = False
                start, windows, anchor = anchors.segments(own, valid)
                if not len(start):
                    continue
                view = memoryview(own)
                prints = np.array([xxhash.xxh3_128_intdigest(view[s:s + w + over]).to_bytes(16, "little")
                                   for s, w in zip(start.tolist(), windows.tolist())], "S16")
                halves = np.frombuffer(prints.tobytes(), "<i8").reshape(-1, 2)
                row = np.searchsorted(offsets[first:last + 1], a + start, "right") - 1 + first
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[0][row]), pa.array(names[1][row]), pa.array(a + start - offsets[row]),
                     pa.array(windows.astype(np.int32)), _signed(anchor), pa.array(halves[:, 0].copy()),
                     pa.array(halves[:, 1].copy())], schema=_SEGMENTS)

    return docs.where(F.octet_length("text") >= length).mapInArrow(run, _SEGMENTS_SQL)


# -- texts of the segments that are compared -----------------------------------------


def _packed_once(docs: DataFrame) -> DataFrame:
    """text_a, text_b, packed: texts compressed for the shuffle, each about once a task."""
    def run(batches):
        pack = zstandard.ZstdCompressor(level=1)
        seen: set = set()
        for b in batches:
            for at in range(0, b.num_rows, 500):
                s = b.slice(at, 500)
                rows = []
                for x, y, text in zip(*[c.to_pylist() for c in s.columns]):
                    if (x, y) in seen:
                        continue
                    if len(seen) >= _REMEMBERED:
                        seen.clear()
                    seen.add((x, y))
                    rows.append((x, y, pack.compress(text)))
                yield to_batch(rows, _PACKED)

    return docs.mapInArrow(run, _PACKED_SQL)


_PACKED_SQL = "text_a long, text_b long, packed binary"
_PACKED = pa.schema([("text_a", pa.int64()), ("text_b", pa.int64()), ("packed", pa.binary())])


def segment_texts(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of wanted segments (text_a, text_b, start, windows, anchor, seg_a, seg_b), each once."""
    lists = wanted.groupBy("text_a", "text_b").agg(F.collect_list(F.struct("start", "windows", "anchor", "seg_a", "seg_b")).alias("parts"))

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            rows, size = [], 0
            for at in range(b.num_rows):
                packed, parts = (c[at].as_py() for c in b.columns)
                text = unpack.decompress(packed)
                for p in parts:
                    own = text[p["start"]:p["start"] + p["windows"] + length - 1]
                    rows.append((p["anchor"], p["seg_a"], p["seg_b"], own))
                    size += len(own)
                    if size >= FLUSH_BYTES:
                        yield to_batch(rows, _TEXTS)
                        rows, size = [], 0
            yield to_batch(rows, _TEXTS)

    return _packed_once(docs).join(lists, ["text_a", "text_b"]).select("packed", "parts").mapInArrow(run, _TEXTS_SQL) \
        .dropDuplicates(["seg_a", "seg_b"])


# -- shards ----------------------------------------------------------------------


def repeated_starts(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each text, the starts of its strings of ``length`` bytes that start elsewhere in the texts too."""
    data = np.frombuffer(_END.join([*texts, b""]), np.uint8)
    sa = suffix_array(data)
    common = permuted_common_prefixes(data, sa)
    far = common >= length
    # the suffix before one that agrees with it agrees as well
    at = np.flatnonzero(far[sa])
    far[sa[at - 1]] = True
    ends = np.cumsum([len(t) + 1 for t in texts])
    out = []
    for e, t in zip(ends.tolist(), texts):
        begin = e - 1 - len(t)
        out.append(np.flatnonzero(far[begin:max(begin, e - length)]))
    return out


def _ranges(starts: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, last) of the stretches of consecutive numbers in a sorted array."""
    if len(starts):
        cut = np.flatnonzero(np.diff(starts) > 1)
        yield from zip(starts[np.append(0, cut + 1)].tolist(), starts[np.append(cut, len(starts) - 1)].tolist())


def search_shards(texts: DataFrame, shards: int, length: int) -> DataFrame:
    """Ranges of repeated windows of segments whose anchors fit into shards."""
    def search(table: pa.Table) -> pa.Table:
        rows = []
        own = table["bytes"].to_pylist()
        for a, b, starts in zip(table["seg_a"].to_pylist(), table["seg_b"].to_pylist(), repeated_starts(own, length)):
            rows += [(a, b, x, y) for x, y in _ranges(starts)]
        return pa.Table.from_batches([to_batch(rows, _RANGES)])

    return texts.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards).cast("long"))) \
        .groupBy("shard").applyInArrow(search, _RANGES_SQL)


_WINDOWS_SQL = "win_a long, win_b long, seg_a long, seg_b long, at int"
_WINDOWS = pa.schema([("win_a", pa.int64()), ("win_b", pa.int64()), ("seg_a", pa.int64()), ("seg_b", pa.int64()), ("at", pa.int32())])


def count_windows(texts: DataFrame, length: int) -> DataFrame:
    """Ranges of repeated windows, of segments with an anchor too common for a shard."""
    def run(batches):
        for b in batches:
            for at in range(b.num_rows):
                own = memoryview(b.column("bytes")[at].as_py())
                n = len(own) - length + 1
                prints = b"".join(xxhash.xxh3_128_intdigest(own[i:i + length]).to_bytes(16, "little") for i in range(n))
                halves = np.frombuffer(prints, "<i8").reshape(-1, 2)
                seg = [np.full(n, b.column(c)[at].as_py(), np.int64) for c in ("seg_a", "seg_b")]
                yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), *map(pa.array, seg),
                                                  pa.array(np.arange(n, dtype=np.int32))], schema=_WINDOWS)

    path = scratch_path(texts.sparkSession, "repeats-windows")
    texts.mapInArrow(run, _WINDOWS_SQL).write.parquet(path)
    windows = texts.sparkSession.read.schema(_WINDOWS_SQL).parquet(path)
    many = windows.groupBy("win_a", "win_b").agg(F.count("*").alias("n")).where("n > 1").select("win_a", "win_b")
    found = windows.join(many, ["win_a", "win_b"], "left_semi").groupBy("seg_a", "seg_b").agg(F.sort_array(F.collect_set("at")).alias("ats"))
    # stretches of consecutive starts: a start less its rank is the same all along one
    return found.select("seg_a", "seg_b", F.posexplode("ats").alias("r", "at")) \
        .groupBy("seg_a", "seg_b", (F.col("at") - F.col("r")).alias("run")) \
        .agg(F.min("at").alias("first"), F.max("at").alias("last")).drop("run")


# -- whole ------------------------------------------------------------------------


def cut(text: bytes, ranges: list[tuple[int, int]] | None) -> tuple[int, bytes]:
    """(number of maximal removed runs, what is left) without the bytes of some [start, end)."""
    kept, spans, at = [], 0, 0
    for a, b in sorted(ranges or ()):
        if b <= at:
            continue
        if a > at or not spans:
            spans += 1
            kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    return spans, b"".join(kept)


def remove_repeats(docs: DataFrame, length: int = LENGTH, shard_bytes: int = SHARD_BYTES,
                   id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_spans (maximal removed runs) and kept (the bytes left) of every row."""
    if length < 2:
        raise ValueError("a length of at least 2 bytes is needed")
    spark = docs.sparkSession
    ship_package(spark)
    own = pick(docs, id_column, text_column).select(
        F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).cast("binary").alias("text"))
    named = own.select("doc_id", "text", *text_name(F.col("text")))
    path = scratch_path(spark, "repeats-segments")
    segment_table(named.select("text_a", "text_b", "text"), length).write.parquet(path)
    segments = spark.read.schema(_SEGMENTS_SQL).parquet(path)

    kinds = segments.groupBy("anchor", "seg_a", "seg_b", "windows").agg(F.count("*").alias("n"))
    size = F.col("windows").cast("long") + (length - 1)
    anchors = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum("n").alias("all"), F.sum(size).alias("bytes")) \
        .where("all > 1")
    path = scratch_path(spark, "repeats-kinds")
    kinds.join(anchors, "anchor").select("anchor", "seg_a", "seg_b", "windows", "n", "kinds", "bytes").write.parquet(path)
    kinds = spark.read.schema("anchor long, seg_a long, seg_b long, windows int, n long, kinds long, bytes long").parquet(path)

    compared = kinds.where("kinds > 1")
    path = scratch_path(spark, "repeats-known")
    # segments whose anchor occurs elsewhere, with what is known of them
    segments.join(kinds.select("seg_a", "seg_b", "n", "kinds", F.col("bytes").alias("hot")), ["seg_a", "seg_b"]).write.parquet(path)
    known = spark.read.schema(f"{_SEGMENTS_SQL}, n long, kinds long, hot long").parquet(path)
    one = known.where("kinds > 1").groupBy("seg_a", "seg_b").agg(
        F.min(F.struct("text_a", "text_b", "start", "windows", "anchor")).alias("p")).select("p.*", "seg_a", "seg_b")
    path = scratch_path(spark, "repeats-texts")
    segment_texts(named.select("text_a", "text_b", "text"), one, length) \
        .join(compared.select("seg_a", "seg_b", (F.col("bytes") > shard_bytes // 2).alias("hot")), ["seg_a", "seg_b"]) \
        .select("anchor", "seg_a", "seg_b", "bytes", "hot").write.parquet(path)
    texts = spark.read.schema(f"{_TEXTS_SQL}, hot boolean").parquet(path)
    total = texts.where("not hot").agg(F.sum(F.octet_length("bytes")).alias("n")).first().n or 0
    found = search_shards(texts.where("not hot").drop("hot"), max(1, -(-total // shard_bytes)), length) \
        .union(count_windows(texts.where("hot").drop("hot"), length))
    whole = kinds.where("n > 1").select("seg_a", "seg_b", F.lit(0).alias("first"), (F.col("windows") - 1).alias("last"))
    path = scratch_path(spark, "repeats-ranges")
    found.join(whole, ["seg_a", "seg_b"], "left_anti").union(whole).write.parquet(path)
    ranges = spark.read.schema(_RANGES_SQL).parquet(path)

    gone = known.select("text_a", "text_b", "start", "seg_a", "seg_b").join(ranges, ["seg_a", "seg_b"]) \
        .select("text_a", "text_b", F.struct((F.col("start") + F.col("first")).cast("int").alias("a"),
                                             (F.col("start") + F.col("last") + length).cast("int").alias("b")).alias("cut")) \
        .groupBy("text_a", "text_b").agg(F.collect_set("cut").alias("cuts"))
    # stored, so that the join below deals both sides itself and a text that many rows hold can be split
    path = scratch_path(spark, "repeats-cuts")
    gone.write.parquet(path)
    gone = spark.read.schema("text_a long, text_b long, cuts array<struct<a: int, b: int>>").parquet(path)

    def pack(batches):
        squeeze = zstandard.ZstdCompressor(level=1)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                s = b.slice(at, 500)
                cols = list(s.columns)
                cols[3] = pa.array([squeeze.compress(t) for t in cols[3].to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays(cols, schema=_ROWS)

    def cut_out(batches):
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            rows, held = [], 0
            for at in range(b.num_rows):
                doc, packed, cuts = (c[at].as_py() for c in b.columns)
                text = unpack.decompress(packed)
                spans, kept = cut(text, cuts and [(c["a"], c["b"]) for c in cuts])
                rows.append((doc, len(text), spans, kept))
                held += len(kept) + 64
                if held >= FLUSH_BYTES:
                    yield to_batch(rows, _KEPT)
                    rows, held = [], 0
            yield to_batch(rows, _KEPT)

    packed = named.select("doc_id", "text_a", "text_b", "text").mapInArrow(pack, "doc_id long, text_a long, text_b long, packed binary")
    return packed.join(gone, ["text_a", "text_b"], "left").select("doc_id", "packed", "cuts").mapInArrow(cut_out, _KEPT_SQL)


_ROWS = pa.schema([("doc_id", pa.int64()), ("text_a", pa.int64()), ("text_b", pa.int64()), ("packed", pa.binary())])
