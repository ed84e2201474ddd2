"""Periodic runs of words, by internal pattern matching.

A run is a stretch of consecutive words with smallest period q, at least ``LEAST_REPEATS`` * q and ``LEAST_WORDS`` long, that
no neighbouring word extends with period q.

1. Word numbers of many texts stand one after another, no number shared by two texts.  Suffixes are
   sorted by doubling; after the round for length 2**k a group of suffixes that agree in so many words is an
   interval of the suffix array, and only groups of several are sorted further.
2. For each k every block of 2**k words at a multiple of 2**k whose interval holds others is a pattern.
   Its occurrences in the neighbouring windows are the range successor and predecessor of its place in the interval,
   answered by a wavelet tree over the suffix array: a count of smaller places, then a
   selection, level by level for all blocks at once (a level is made, used and left).
3. Occurrences less than a block apart form a progression, whose difference is the block's period.  A run of period
   q (at least 4 q long) holds an aligned block of the power of two above q, at most 2 q, and the
   block's next occurrence on one side at distance q exactly: one nearer would give the run a
   smaller period.  So differences from half a block up to it, per block, are all candidate periods.
4. A candidate is extended to both sides as long as words q apart agree.

All of a text's words are in one task; its memory is linear in them.

Null text is empty; a null id is never changed by ``planted``; repeated ids and rows are treated one by one; other
columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

from itertools import compress
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import FLUSH_BYTES, pick, to_batch

LEAST_WORDS = 6
LEAST_REPEATS = 4
#: Words handled at once; a longer text is handled alone.
_AT_ONCE = 1 << 17

SCHEMA = "doc_id long, n_words long, runs array<struct<start:long, length:long, period:long>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])


def sorted_suffixes(words: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]:
    """The suffix array, and per block size 2, 4, … the aligned places whose block occurs again, with
    the first and last + 1 index of the block's interval."""
    n = len(words)
    sa = np.argsort(words, kind="stable")
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    head = np.concatenate([[True], words[sa[1:]] != words[sa[:-1]]])
    first = np.flatnonzero(head)
    many = np.diff(np.append(first, n))
    rank[sa] = np.repeat(first, many)
    # indices of the array that are in groups of several, and their groups' beginnings
    at = np.flatnonzero(np.repeat(many > 1, many))
    blocks, size = [], 1
    while len(at):
        i = sa[at]
        group = rank[i]
        follow = rank[np.minimum(i + size, n)]
        o = np.lexsort((follow, group))
        i, group, follow = i[o], group[o], follow[o]
        sa[at] = i
        head = np.concatenate([[True], (group[1:] != group[:-1]) | (follow[1:] != follow[:-1])])
        first = np.flatnonzero(head)
        many = np.diff(np.append(first, len(at)))
        begin = np.repeat(at[first], many)
        rank[i] = begin
        size *= 2
        keep = np.repeat(many > 1, many)
        at, i, begin, length = at[keep], i[keep], begin[keep], np.repeat(many, many)[keep]
        aligned = i % size == 0
        blocks.append((size, i[aligned], begin[aligned], (begin + length)[aligned]))
    return sa, blocks


class WaveletTree:
    """Counts and selections in ranges of an array of different numbers below its length."""

    def __init__(self, values: np.ndarray):
        self.values, self.bits = values, max(1, int(len(values) - 1).bit_length())

    def _levels(self):
        """(bit, numbers with a 0 bit before each index, zeros of the level), highest bit first."""
        now = self.values
        for bit in range(self.bits - 1, -1, -1):
            one = (now >> bit & 1).astype(bool)
            zeros = np.concatenate([[0], np.cumsum(~one)])
            yield bit, zeros, int(zeros[-1])
            now = np.concatenate([now[~one], now[one]])

    def smaller(self, low: np.ndarray, high: np.ndarray, than: np.ndarray) -> np.ndarray:
        """How many numbers at indices low up to high are smaller."""
        count = np.zeros(len(low), np.int64)
        for bit, zeros, all_zeros in self._levels():
            a, b = zeros[low], zeros[high]
            one = (than >> bit & 1).astype(bool)
            count += np.where(one, b - a, 0)
            low, high = np.where(one, all_zeros + low - a, a), np.where(one, all_zeros + high - b, b)
        return count

    def select(self, low: np.ndarray, high: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """The number that nth others at indices low up to high are smaller than."""
        value = np.zeros(len(low), np.int64)
        for bit, zeros, all_zeros in self._levels():
            a, b = zeros[low], zeros[high]
            one = nth >= b - a
            nth = np.where(one, nth - (b - a), nth)
            value |= one.astype(np.int64) << bit
            low, high = np.where(one, all_zeros + low - a, a), np.where(one, all_zeros + high - b, b)
        return value


def candidates(words: np.ndarray) -> set[tuple[int, int]]:
    """(place, period): words from place on, at least one period long, stand again a period later."""
    sa, blocks = sorted_suffixes(words)
    if not blocks:
        return set()
    size = np.concatenate([np.full(len(p), s) for s, p, _, _ in blocks])
    place, low, high = (np.concatenate([b[k] for b in blocks]) for k in (1, 2, 3))
    if not len(place):
        return set()
    tree = WaveletTree(sa)
    before = tree.smaller(low, high, place)
    out = set()
    for there, nth in ((before > 0, before - 1), (before + 1 < high - low, before + 1)):
        other = tree.select(low[there], high[there], nth[there])
        far = np.abs(other - place[there])
        near = (2 * far >= size[there]) & (far < size[there])
        out.update(zip(np.minimum(other, place[there])[near].tolist(), far[near].tolist()))
    return out


def _agreeing(words: np.ndarray, at: int, period: int, step: int) -> int:
    """How many words from ``at`` on (by step 1 or -1) equal the ones a period later."""
    n, total, width = len(words), 0, 64
    while True:
        if step > 0:
            a, b = at + total, min(at + total + width, n - period)
        else:
            a, b = max(at - total - width + 1, 0), at - total + 1
        if a >= b:
            return total
        differ = np.flatnonzero(words[a:b] != words[a + period:b + period])
        if len(differ):
            return total + (int(differ[0]) if step > 0 else b - a - 1 - int(differ[-1]))
        total += b - a
        width *= 2


def find_runs(words: np.ndarray, least: int = LEAST_WORDS, repeats: int = LEAST_REPEATS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least four periods, by start, then period.  No text's word may
    stand in another text."""
    out, end = [], {}
    for at, period in sorted(candidates(words)):
        if at < end.get(period, 0):
            continue
        # a candidate inside a known run lies before the run's last period
        stop = at + _agreeing(words, at, period, 1)
        start = at - _agreeing(words, at - 1, period, -1)
        end[period] = stop
        if stop + period - start >= max(least, repeats * period):
            out.append((start, stop + period - start, period))
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """For one id in ten: from some word on, the words repeat with a period that fits three to ten times."""
    n = len(words)
    h = crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def periodic_runs(docs: DataFrame, plant: bool = False, least: int = LEAST_WORDS, repeats: int = LEAST_REPEATS,
                  id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and collapsed: the words, joined by blanks, without those that
    any run holds after its first period.  ``plant`` first makes one text in ten periodic."""
    if repeats < LEAST_REPEATS:
        raise ValueError("runs of fewer than four periods aren't all found")
    ship_package(docs.sparkSession)

    def solve(texts):
        """Rows of some (doc id, words)."""
        ids, at, cut = [], 0, [0]
        for _, words in texts:
            number: dict = {}
            ids.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)) + at)
            at += len(number)
            # one more number ends the text
            ids.append(np.array([at]))
            at += 1
            cut.append(cut[-1] + len(words) + 1)
        mine: list[list] = [[] for _ in texts]
        for start, length, period in find_runs(np.concatenate(ids), least, repeats):
            k = int(np.searchsorted(cut, start, "right")) - 1
            mine[k].append({"start": start - cut[k], "length": length, "period": period})
        for (doc, words), runs in zip(texts, mine):
            keep = words
            if runs:
                stay = np.ones(len(words), bool)
                for r in runs:
                    stay[r["start"] + r["period"]:r["start"] + r["length"]] = False
                keep = compress(words, stay.tolist())
            yield doc, len(words), runs, b" ".join(keep).decode()

    def run(batches):
        held, size, rows, weight = [], 0, [], 0
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                for doc, text in zip(*[c.to_pylist() for c in b.slice(at, 1000).columns]):
                    words = text.split()
                    if plant:
                        words = planted(words, doc)
                    if size + len(words) > _AT_ONCE and held:
                        for row in solve(held):
                            rows.append(row)
                            weight += 64 + len(row[3]) + 64 * len(row[2])
                            if weight >= FLUSH_BYTES:
                                yield to_batch(rows, _ARROW)
                                rows, weight = [], 0
                        held, size = [], 0
                    held.append((doc, words))
                    size += len(words) + 1
        if held:
            rows += solve(held)
        yield to_batch(rows, _ARROW)

    # bytes are split at the six ASCII blanks only, text would be at others too
    rows = pick(docs, id_column, text_column).select(
        F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, SCHEMA)
