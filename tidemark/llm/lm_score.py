"""Language-model scores from a log-frequency Bloom filter.

Training counts of word pairs are quantised to q = 1 + floor(log2 c), and the filter holds
(pair, 1) ... (pair, q).  A lookup probes level after level until one is missing: the levels
found give back a count (the middle of its power-of-two range).  The score is

    p(w | h) = (min(c(h w), c(h)) + mu * p(w)) / (c(h) + mu),  p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)),

the words' own counts c(w) being exact (a sorted table of 64-bit word hashes).  A text starts
after a begin mark, whose count is the number of training documents, and ends with an end token.

Filter and word table are cut into shards by hash, sized from the corpus, so the model grows
with it.  Tasks count the pairs of many documents and send each shard one packed block at a
time; one task per shard merges its blocks and sets its bits.  Workers get the shards by
broadcast, at most ``round_mb`` at once: a model within that bound is scored in one
pass; a larger one in rounds, each adding what its shards know to two small arrays per
document (written between rounds), with the same result.

Defined cases: null text is empty (the end token alone); null ids, repeated rows, words
of any length and a corpus without training documents are scored like any others; an empty
table gives no row; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_remainder, pick, to_batch
from ..session import scratch_path, ship_package

#: Bits of the filter for each (pair, level), probes of a lookup, prior weight of p(w).
BITS_PER_KEY = 12
PROBES = 5
MU = 100.0
#: Text bytes that one shard stands for, and tokens that a task counts at once.
SHARD_BYTES = 16 << 20
GATHER = 1 << 20
#: Pairs whose bits are set at once, and documents that are scored at once.
_PAIRS_AT_ONCE, _DOCS_AT_ONCE = 1 << 18, 250
#: Levels of quantised counts (2**40 and beyond are one level).
LEVELS = 40
#: MB of model that are broadcast at once.
ROUND_MB = 256

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_END = np.uint64(0x9E3779B97F4A7C15)      # the end token: no word hashes are compared with it by text
_BEGIN = np.uint64(0xD1B54A32D192ED03)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Bytes of the words (with ``_ENTRY`` for an entry itself) that a task keeps the hashes of; a longer word is not kept.
_HELD = 32 << 20
_ENTRY, _LONGEST = 170, 64

_BLOCK = pa.schema([("shard", pa.int32()), ("pair_keys", pa.binary()), ("pair_counts", pa.binary()),
                    ("word_keys", pa.binary()), ("word_counts", pa.binary())])
_BLOCK_SQL = "shard int, pair_keys binary, pair_counts binary, word_keys binary, word_counts binary"
_SHARD = pa.schema([("shard", pa.int32()), ("bits", pa.binary()), ("word_keys", pa.binary()),
                    ("word_counts", pa.binary()), ("n_words", pa.int64()), ("n_tokens", pa.int64()), ("n_pairs", pa.int64())])
_SHARD_SQL = "shard int, bits binary, word_keys binary, word_counts binary, n_words long, n_tokens long, n_pairs long"


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (every input bit reaches every output bit)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(3) + mix(word))


class WordHashes(dict):
    """Word -> 64-bit hash, kept for the words a task has met."""

    held = 0

    def __missing__(self, w: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(w)
        if len(w) <= _LONGEST:
            if self.held >= _HELD:
                self.clear()
                self.held = 0
            self.held += _ENTRY + len(w)
            self[w] = h
        return h

    def of(self, text: str | None) -> np.ndarray:
        """Hashes of a text's lower-cased words, then the end token's."""
        words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
        out = np.empty(len(words) + 1, np.uint64)
        out[:-1] = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        out[-1] = _END
        return out


def before(words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each token's predecessor, documents one after another (the begin mark at a document's start)."""
    out = np.empty_like(words)
    out[1:] = words[:-1]
    starts = np.cumsum(lengths) - lengths
    out[starts] = _BEGIN
    return out


def add_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[first], np.add.reduceat(counts[order], first)


def _salt(level: int) -> np.uint64:
    return np.uint64(level * int(_M2) & (1 << 64) - 1)


def places(keys: np.ndarray, level: int, size: np.ndarray):
    """The PROBES bit places of (key, level) in a filter of ``size`` bits, one array after another."""
    a = mix(keys + _salt(level))
    b = mix(a) | np.uint64(1)
    for _ in range(PROBES):
        yield a % size
        a = a + b


def build_shards(train: DataFrame, n_shards: int) -> DataFrame:
    """One row per shard: its filter bits and its words' exact counts."""
    ship_package(train.sparkSession)

    def count(batches):
        hashes, docs, n = WordHashes(), [], 0

        def blocks():
            lengths = np.array([len(d) for d in docs])
            words = np.concatenate(docs)
            docs.clear()
            pairs, pair_n = np.unique(pair_keys(before(words, lengths), words), return_counts=True)
            single, single_n = np.unique(words, return_counts=True)
            cut = [(k, c, np.argsort(s, kind="stable"), s) for k, c in ((pairs, pair_n), (single, single_n))
                   for s in ((k % np.uint64(n_shards)).astype(np.int32),)]
            edges = [np.searchsorted(s[o], np.arange(n_shards + 1)) for _, _, o, s in cut]
            rows = []
            for shard in range(n_shards):
                row = [shard]
                for (k, c, o, _), e in zip(cut, edges):
                    take = o[e[shard]:e[shard + 1]]
                    row += [k[take].astype("<u8").tobytes(), c[take].astype("<u4").tobytes()]
                if len(row[1]) or len(row[3]):
                    rows.append(tuple(row))
            return to_batch(rows, _BLOCK)

        for batch in batches:
            for text in batch.column(0).to_pylist():
                docs.append(hashes.of(text))
                n += len(docs[-1])
                if n >= GATHER:
                    yield blocks()
                    n = 0
        if docs:
            yield blocks()

    def merge(table: pa.Table) -> pa.Table:
        got = []
        for k, c in (("pair_keys", "pair_counts"), ("word_keys", "word_counts")):
            keys = np.concatenate([np.frombuffer(x, "<u8") for x in table[k].to_pylist()])
            counts = np.concatenate([np.frombuffer(x, "<u4") for x in table[c].to_pylist()]).astype(np.uint64)
            got.append(add_up(keys, counts))
        (pairs, pair_n), (words, word_n) = got
        level = np.minimum(np.frexp(pair_n.astype(np.float64))[1], LEVELS)
        size = max(64, -(-int(level.sum()) * BITS_PER_KEY // 64) * 64)
        bits = np.zeros(size, bool)
        for q in range(1, int(level.max()) + 1 if len(level) else 1):
            for first in range(0, len(pairs), _PAIRS_AT_ONCE):
                some = slice(first, first + _PAIRS_AT_ONCE)
                for at in places(pairs[some][level[some] >= q], q, np.uint64(size)):
                    bits[at.astype(np.int64)] = True
        return pa.Table.from_batches([to_batch([(
            table["shard"][0].as_py(), np.packbits(bits, bitorder="little").tobytes(), words.astype("<u8").tobytes(),
            word_n.astype("<u8").tobytes(), len(words), int(word_n.sum()), len(pairs))], _SHARD)])

    return train.select("text").mapInArrow(count, _BLOCK_SQL).groupBy("shard").applyInArrow(merge, _SHARD_SQL)


class Shards:
    """Some shards' filters and words in flat arrays, for lookups of many keys at once."""

    def __init__(self, rows, n_shards: int):
        self.n_shards = n_shards
        self.size = np.zeros(n_shards, np.uint64)
        self.start = np.zeros(n_shards, np.int64)
        # a row goes as soon as it is taken: together they are as large as what is made of them
        bits, keys, counts = bytearray(), [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)]
        for shard, own, own_keys, own_counts in rows:
            self.start[shard], self.size[shard] = 8 * len(bits), 8 * len(own)
            bits += own
            keys.append(np.frombuffer(own_keys, "<u8"))
            n = np.frombuffer(own_counts, "<u8")
            counts.append(n.astype(np.uint32) if not len(n) or n.max() < 1 << 32 else n)
        self.bits = np.frombuffer(bits, np.uint8)
        keys, counts = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(keys, kind="stable")
        self.words, self.counts = keys[order], counts[order]

    def word_counts(self, words: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(words), np.uint64)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, self.counts[at], 0).astype(np.uint64)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Levels found, probed one after another; a key drops out at its first missing level."""
        out = np.zeros(len(keys), np.uint8)
        shard = (keys % np.uint64(self.n_shards)).astype(np.int64)
        live = np.flatnonzero(self.size[shard])
        for q in range(1, LEVELS + 1):
            a = mix(keys[live] + _salt(q))
            b = mix(a) | np.uint64(1)
            for _ in range(PROBES):
                own = shard[live]
                at = self.start[own] + (a % self.size[own]).astype(np.int64)
                found = (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
                live, a, b = live[found], (a + b)[found], b[found]
            if not len(live):
                return out
            out[live] = q
        return out


def count_of_level(level: np.ndarray) -> np.ndarray:
    """The middle of the counts that share a level (2**(q-1) ... 2**q - 1); 0 for none."""
    return np.where(level > 0, (2.0 ** (level.astype(np.float64) - 1) * 3 - 1) / 2, 0.0)


def log_scores(words_n, before_n, level, n_tokens: int, n_words: int, mu: float):
    """(base, model) log10 probability of every token."""
    p = (words_n + 0.1) / (n_tokens + 0.1 * (n_words + 1))
    seen = before_n.astype(np.float64)
    pair = np.minimum(count_of_level(level), seen)
    return np.log10(p), np.log10((pair + mu * p) / (seen + mu))


_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                  ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
_OUT_SQL = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_PART = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("words_n", pa.binary()), ("level", pa.binary())])
_PART_SQL = "doc_id long, text string, words_n binary, level binary"

def score_documents(docs: DataFrame, train: DataFrame, mu: float = MU, round_mb: int = ROUND_MB,
                    shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Scores of ``docs`` (doc_id, text) under a model of ``train`` (text); log10 throughout."""
    spark = docs.sparkSession
    ship_package(spark)
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    learn = pick(train, "text")
    size = learn.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    n_shards = max(8, -(-size // shard_bytes))
    path = scratch_path(spark, "lm-shards")
    build_shards(learn, n_shards).write.parquet(path)
    shards = spark.read.schema(_SHARD_SQL).parquet(path)
    sizes = shards.select("shard", "n_words", "n_tokens",
                          (F.octet_length("bits") + F.octet_length("word_keys") + F.octet_length("word_counts")).alias("b")).collect()
    n_words, n_tokens = sum(r.n_words for r in sizes), sum(r.n_tokens for r in sizes)
    n_train = learn.count()
    rounds, room = [[]], round_mb << 20
    for r in sorted(sizes, key=lambda r: r.shard):
        if r.b > room and rounds[-1]:
            rounds.append([])
            room = round_mb << 20
        rounds[-1].append(r.shard)
        room -= r.b
    for k, own in enumerate(rounds):
        got = shards.where(F.col("shard").isin(own)).select("shard", "bits", "word_keys", "word_counts")
        shared = spark.sparkContext.broadcast(Shards(map(tuple, got.toLocalIterator()) if own else [], n_shards))
        last = k == len(rounds) - 1
        step = _round(shared, k == 0, last, n_tokens, n_words, n_train, mu)
        if last:
            return rows.mapInArrow(step, _OUT_SQL)
        between = scratch_path(spark, "lm-round")
        rows.mapInArrow(step, _PART_SQL).write.parquet(between)
        shared.unpersist()
        rows = spark.read.schema(_PART_SQL).parquet(between)


def _round(shared, first, last, n_tokens, n_words, n_train, mu):
    """One pass over the documents with some of the shards."""
    def run(batches):
        known, hashes = shared.value, WordHashes()
        for b in batches:
            for at in range(0, b.num_rows, _DOCS_AT_ONCE):
                yield answer(b.slice(at, _DOCS_AT_ONCE), known, hashes)

    def answer(b, known, hashes):
        texts = b.column(1).to_pylist()
        docs = [hashes.of(t) for t in texts]
        lengths = np.array([len(d) for d in docs])
        words = np.concatenate(docs)
        level = known.levels(pair_keys(before(words, lengths), words))
        words_n = known.word_counts(words)
        if not first:
            words_n = np.maximum(words_n, np.frombuffer(b"".join(b.column(2).to_pylist()), "<u8"))
            level = np.maximum(level, np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8))
        ends = np.cumsum(lengths)
        starts = ends - lengths
        if not last:
            return to_batch([(doc, t, words_n[s:e].astype("<u8").tobytes(), level[s:e].tobytes())
                             for doc, t, s, e in zip(b.column(0).to_pylist(), texts, starts, ends)], _PART)
        before_n = np.empty_like(words_n)
        before_n[1:] = words_n[:-1]
        before_n[starts] = n_train
        base, score = log_scores(words_n, before_n, level, n_tokens, n_words, mu)
        return pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(lengths), pa.array(np.add.reduceat((words_n > 0).astype(np.int64), starts)),
             pa.array(np.full(len(starts), n_tokens)),
             pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(score, starts))], schema=_OUT)

    return run


def held_out():
    """The documents kept from learning: crc32 of doc_id as text leaves 0 modulo 10 (a null id is not)."""
    return F.coalesce(crc_remainder(F.col("doc_id"), 10) == 0, F.lit(False))


def score_table(docs: DataFrame, **settings) -> DataFrame:
    """Every document's score, learning from those not held out."""
    own = pick(docs, "doc_id", "text")
    return score_documents(own, own.where(~held_out()), **settings).withColumn("held_out", held_out())
