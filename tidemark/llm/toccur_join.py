"""Similarity join of documents on word shingles, by T-occurrence search.

Documents link when the Jaccard similarity of their shingle sets reaches a threshold.  The steps:

1. Each whole text becomes a set of 64-bit shingle hashes.  Equal sets are one node, so
   copies cost nothing further.
2. Two count sketches of fixed size order the shingles, rare ones first: a shingle is as frequent
   as its words' counts let expect, or as its own class of shingles shows, if that stands out.
   (Shingles alone fill any fixed number of classes as texts grow, and then tell rare from
   frequent no more; words do not.)  Of two sets that link, of n shingles and more, both have at
   least s(n) = SHARED + n / ``SHARE`` of what they share (all, if it is less) among their first
   m - ceil(t m) + s(m) of m shingles, so nodes meet in the lists of those prefix shingles.
   Lists of up to ``SHORT_LIST`` nodes give their pairs, and a pair that meets often enough is
   searched; a pair that meets in a longer list is searched with that list.
3. Each longer list names one node (the one that meets most others) as query, and the list's other
   nodes are searched for it: nodes of a size that can't link are left out, the rest form
   an inverted index, and the search asks for those that occur at least T times in the
   query's lists.  It heap-merges the short lists, skipping ahead where too few agree, and
   binary-probes the long ones (DivideSkip); the exact overlap decides.
4. The query leaves its list: it has met all the others.  A list whose other nodes are in one
   component is done, since no link in it can change the result.  In the lists that are left,
   every node outside the largest component is searched for among the nodes of other
   components.

Before the sets of a search's nodes are made and moved, their parity prints (2 to 4 bits a shingle) are:
prints that differ in more bits than linked sets differ in shingles tell a pair that can't link.

So a group of near copies, however large, is joined by the searches of its few outliers
instead of all its pairs, and no link between different components is lost.  Searches of many
nodes are cut into blocks of ``BLOCK``, and blocks of queries meet blocks of the index.

Defined cases: null and empty texts have no shingles and link with nothing; fewer words than
``width`` are one shingle of their own length; equal similarities all count; repeated rows
share a node; rows of one doc_id with different texts are different nodes; a row without a doc_id links
like any other but names no component (one of such rows only has none); other columns are ignored; an
empty table gives no row.
"""

from __future__ import annotations

from bisect import bisect_left
from heapq import heapify, heappop
from math import log2
from zlib import compress, decompress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_held, map_rows, pick, small, tidy, to_batch
from .graph import components
from .lm_score import WordHashes, mix
from ..session import cut_lineage, scratch_path, ship_package

WIDTH = 4
#: Jaccard threshold in hundredths.
PERCENT = 85
#: Prefix shingles that two nodes must share where all their shared lists are short, and
#: shingles of the smaller node for which it is one more.
SHARED = 4
SHARE = 32
#: Nodes of one search block.
BLOCK = 256
#: Each sketch has 2**SKETCH_BITS counters: its size doesn't depend on the data.
SKETCH_BITS = 21
_CHUNK_BITS = 15
#: Codes count octaves in so many steps.
_OCTAVE = 8
#: Weight of a long list's probe in DivideSkip's rule for how many lists are long.
_MU = 0.01

#: Nodes of a list whose pairs are counted; longer lists are searched as lists.
SHORT_LIST = 64
#: Prefix shingles that a task packs at once, and nodes it remembers so as not to pack copies twice.
_GATHER = 1 << 20
_SEEN = 1 << 20
#: Text bytes that one part of the hash space stands for.
_PART_BYTES = 16 << 20

_SETS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("parity", pa.binary()), ("chunk", pa.int32()),
                   ("counts", pa.binary())])
_SETS_SQL = "doc_id long, n long, node long, parity binary, chunk int, counts binary"
_ASKED = pa.schema([("list", pa.int64()), ("qb", pa.int64()), ("ib", pa.int64()), ("node", pa.int64()), ("comp", pa.int64()),
                    ("query", pa.bool_()), ("member", pa.bool_())])
_ASKED_SQL = "list long, qb long, ib long, node long, comp long, query boolean, member boolean"
_BLOCKS = pa.schema([("part", pa.int64()), ("tokens", pa.binary()), ("nodes", pa.binary()), ("sizes", pa.binary())])
_MEETINGS = pa.schema([(c, pa.int64()) for c in ("list", "node", "other", "need", "w")])
_MEETINGS_SQL = "list long, node long, other long, need long, w long"
_SKETCH = pa.schema([("chunk", pa.int32()), ("counts", pa.binary())])
_NODE_SET = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("items", pa.binary())])
_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


# -- shingles -----------------------------------------------------------------


def all_shingles(words: np.ndarray, width: int) -> np.ndarray:
    """The shingle hashes of a text's words, in the text's order."""
    n = len(words)
    size = min(n, width)
    if not n:
        return words
    out = np.full(n - size + 1, size, np.uint64)
    for k in range(size):
        out = mix(out * np.uint64(31) + words[k:n - size + 1 + k])
    return out


def shingles(hashes: WordHashes, text: str | None, width: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    return np.unique(all_shingles(hashes.of(text)[:-1], width))


def class_of(hashes: np.ndarray) -> np.ndarray:
    """A hash's counter in a sketch."""
    return (hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def node_of(items: np.ndarray) -> int:
    """A 64-bit name of a set."""
    return xxhash.xxh3_64_intdigest(items.tobytes(), seed=len(items)) - (1 << 63)


def parity_of(items: np.ndarray) -> bytes:
    """For each of 2 to 4 times as many classes as a set has shingles, whether it has an odd number of the class."""
    n = max(64, 1 << (2 * len(items) - 1).bit_length())
    odd = np.bincount((items & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def fold(prints: np.ndarray, width: int) -> np.ndarray:
    """Prints (rows of 64-bit words) of only ``width`` words."""
    while prints.shape[1] > width:
        half = prints.shape[1] // 2
        prints = prints[:, :half] ^ prints[:, half:]
    return prints


def first_pass(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n (set size), node (the set's name) and parity print (both null for an empty set) of every document, and
    each task's part of the count sketches (chunk, counts) in rows of their own: first the chunks
    of the shingles' sketch, then those of the words'."""
    ship_package(docs.sparkSession)
    size, per = 1 << SKETCH_BITS, 1 << _CHUNK_BITS

    @tidy
    def run(batches):
        free_held()
        hashes, total = WordHashes(), np.zeros((2, size), np.uint32)
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                words = [hashes.of(t)[:-1] for t in part.column(1).to_pylist()]
                got = [np.unique(all_shingles(w, width)) for w in words]
                for sketch, found in zip(total, (got, words)):
                    sketch += np.bincount(class_of(np.concatenate(found)), minlength=size).astype(np.uint32)
                yield to_batch([(doc, len(s), *((node_of(s), parity_of(s)) if len(s) else (None, None)), None, None)
                                for doc, s in zip(part.column(0).to_pylist(), got)], _SETS)
        if total.any():
            yield to_batch([(None, None, None, None, k, compress(x.astype("<u4").tobytes(), 1)) for k, x in enumerate(total.reshape(-1, per))], _SETS)

    return docs.select("doc_id", "text").mapInArrow(run, _SETS_SQL)


# -- the order of shingles ------------------------------------------------------


class Order:
    """How frequent shingles are, as far as sketches tell, in steps of 1 / _OCTAVE octave.

    ``words`` has the code of each word class's count, ``shingles`` that of what a shingle class
    counts above a usual one (0 where that could be chance).
    """

    def __init__(self, shingles: np.ndarray, words: np.ndarray):
        self.words = words
        self.all = round(_OCTAVE * np.log2(max(1, _counts(words).sum())))
        n = _counts(shingles)
        usual = np.median(n)
        over = n - usual
        self.shingles = np.where(over > usual / _OCTAVE + 6 * np.sqrt(usual) + 2, _codes(np.maximum(over, 0)), 0).astype(np.uint8)

    def rank(self, words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The sorted distinct shingle hashes of a text's words, and how frequent each is."""
        items, at = np.unique(all_shingles(words, width), return_index=True)
        size = min(len(words), width)
        code = self.words[class_of(words)].astype(np.int32)
        expected = np.full(len(items), -(size - 1) * self.all, np.int32)
        for k in range(size):
            expected += code[at + k]
        seen = self.shingles[class_of(items)].astype(np.int32)
        return items, np.where(seen > 0, np.maximum(seen, expected), expected)


def _codes(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.round(_OCTAVE * np.log2(n + 1)), 255).astype(np.uint8)


def _counts(code: np.ndarray) -> np.ndarray:
    return np.exp2(code / _OCTAVE) - 1


def order_of(first_pass: DataFrame) -> Order:
    """The order of shingles by the sketches of all tasks."""
    per = 1 << _CHUNK_BITS

    @tidy
    def total(table: pa.Table) -> pa.Table:
        n = np.zeros(per, np.uint64)
        for x in table["counts"].to_pylist():
            n += np.frombuffer(decompress(x), "<u4")
        return pa.Table.from_batches([to_batch([(table["chunk"][0].as_py(), _codes(n.astype(np.float64)).tobytes())], _SKETCH)])

    rows = first_pass.where("chunk is not null").select("chunk", "counts") \
        .groupBy("chunk").applyInArrow(total, "chunk int, counts binary").collect()
    out = np.zeros((2 << SKETCH_BITS) // per * per, np.uint8).reshape(-1, per)
    for r in rows:
        out[r.chunk] = np.frombuffer(r.counts, np.uint8)
    return Order(*out.reshape(2, -1))


def least_shared(n, shared: int):
    """Prefix shingles that a set of n shares with a linked one of its size or larger, if they share that many."""
    return shared + n // SHARE


def meetings(docs: DataFrame, order, width: int, percent: int, n_parts: int, short_list: int, shared: int) -> DataFrame:
    """How nodes meet in prefix lists.

    A list of up to ``SHORT_LIST`` nodes gives its pairs of fitting sizes: rows (list 0, node, other,
    lists they need, w lists).  A longer one gives its nodes: rows (list, node, 0, 0, 0); lists
    with the same nodes are one.

    Tasks pack the (shingle, node, size) triples of their prefixes into one block for each part
    of the hash space; a part's task sorts its blocks and keeps the shingles of several nodes.
    """
    ship_package(docs.sparkSession)

    @tidy
    def emit(batches):
        free_held()
        hashes, by = WordHashes(), order.value
        tokens: list[np.ndarray] = []
        nodes: list[tuple[int, int, int]] = []
        seen: set[int] = set()
        held = 0

        def blocks():
            t = np.concatenate(tokens)
            node, n, many = (np.array(x) for x in zip(*nodes))
            node, n = np.repeat(node, many), np.repeat(n, many)
            part = (t % np.uint64(n_parts)).astype(np.int64)
            o = np.argsort(part, kind="stable")
            edge = np.searchsorted(part[o], np.arange(n_parts + 1))
            return to_batch([(p, t[x].astype("<u8").tobytes(), node[x].astype("<i8").tobytes(), n[x].astype("<u4").tobytes())
                             for p in range(n_parts) if edge[p] < edge[p + 1] for x in (o[edge[p]:edge[p + 1]],)], _BLOCKS)

        for b in batches:
            for text in b.column(0).to_pylist():
                s, rank = by.rank(hashes.of(text)[:-1], width)
                if len(s) < 2:
                    continue                        # links only with its own copies
                node = node_of(s)
                if node in seen:
                    continue
                if len(seen) < _SEEN:
                    seen.add(node)
                first = min(len(s), len(s) - -(-percent * len(s) // 100) + least_shared(len(s), shared))
                tokens.append(s[np.argsort(rank, kind="stable")[:first]])
                nodes.append((node, len(s), first))
                held += first
                if held >= _GATHER:
                    yield blocks()
                    tokens, nodes, held = [], [], 0
        if nodes:
            yield blocks()

    @tidy
    def meet(table: pa.Table) -> pa.Table:
        t, node, n = (np.concatenate([np.frombuffer(x, kind) for x in table[c].to_pylist()])
                      for c, kind in (("tokens", "<u8"), ("nodes", "<i8"), ("sizes", "<u4")))
        o = np.lexsort((node, t))
        t, node, n = t[o], node[o], n[o]
        once = np.concatenate([[True], (t[1:] != t[:-1]) | (node[1:] != node[:-1])])
        t, node, n = t[once], node[once], n[once]
        first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        many = np.diff(np.append(first, len(t)))
        keep = np.repeat(many > 1, many)
        t, node, n, many = t[keep], node[keep], n[keep], many[many > 1]
        if not len(t):
            return pa.Table.from_batches([to_batch([], _MEETINGS)])
        first = np.cumsum(many) - many
        # a list's name: a hash of its nodes, in order; lists of one name are one, with a weight
        place = np.arange(len(t), dtype=np.uint64) - np.repeat(first, many).astype(np.uint64)
        name = mix(np.bitwise_xor.reduceat(mix(node.astype(np.uint64) + place * np.uint64(0x9E3779B97F4A7C15)), first) + many.astype(np.uint64))
        name, one, weight = np.unique(name, return_index=True, return_counts=True)
        first, many = first[one], many[one]
        out = []
        for m in np.unique(many[many <= short_list]).tolist():
            own = many == m
            at = first[own][:, None] + np.arange(m)
            i, j = np.triu_indices(m, 1)
            a, b, w = at[:, i].ravel(), at[:, j].ravel(), np.repeat(weight[own], len(i))
            less, more = np.minimum(n[a], n[b]).astype(np.int64), np.maximum(n[a], n[b]).astype(np.int64)
            need = np.minimum(least_shared(less, shared), -(-percent * more // 100))
            fit = 100 * less >= percent * more
            out.append((np.zeros(fit.sum(), np.int64), node[a[fit]], node[b[fit]], need[fit], w[fit]))
        for k in np.flatnonzero(many > short_list).tolist():
            x = slice(first[k], first[k] + many[k])
            out.append((np.full(many[k], name[k].astype(np.int64)), node[x], *np.zeros((3, many[k]), np.int64)))
        cols = [np.concatenate(c).astype(np.int64) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 5
        return pa.table(dict(zip(_MEETINGS.names, cols)), schema=_MEETINGS)

    return docs.select("text").mapInArrow(emit, "part long, tokens binary, nodes binary, sizes binary") \
        .groupBy("part").applyInArrow(meet, _MEETINGS_SQL)


# -- search ---------------------------------------------------------------------


def divide_skip(lists: list[np.ndarray], need: int) -> dict[int, int]:
    """{row: occurrences} of the rows found in at least ``need`` of the sorted lists."""
    lists = sorted((x for x in lists if len(x)), key=len)
    if len(lists) < need:
        return {}
    longest = len(lists[-1])
    n_long = min(need - 1, int(need / (_MU * log2(longest) + 1)) if longest > 1 else need - 1)
    short, long = lists[:len(lists) - n_long], lists[len(lists) - n_long:]
    found = merge_skip([x.tolist() for x in short], need - n_long)
    if not found or not long:
        return {r: n for r, n in found.items() if n >= need}
    # binary probes of all long lists at once: a list's rows are offset by its number
    rows = np.array(sorted(found), np.int64)
    span = int(max(x[-1] for x in long)) + 1
    span = max(span, int(rows[-1]) + 1)
    keys = np.concatenate([x + k * span for k, x in enumerate(long)])
    probes = (np.arange(len(long))[:, None] * span + rows[None, :]).ravel()
    at = np.minimum(np.searchsorted(keys, probes), len(keys) - 1)
    hits = (keys[at] == probes).reshape(len(long), -1).sum(0)
    return {r: n for r, h in zip(rows.tolist(), hits.tolist()) if (n := found[r] + h) >= need}


def merge_skip(lists: list[list[int]], need: int) -> dict[int, int]:
    """Heap merge of sorted lists that keeps rows in at least ``need`` of them.

    Where fewer agree, the next ``need - 1`` smallest heads are moved on to the row after them,
    by binary search: no row before it can have enough occurrences.
    """
    out: dict[int, int] = {}
    heap = [(x[0], k, 0) for k, x in enumerate(lists)]
    heapify(heap)
    while len(heap) >= need:
        row, same = heap[0][0], 0
        taken = []
        while heap and heap[0][0] == row:
            taken.append(heappop(heap))
            same += 1
        if same >= need:
            out[row] = same
            target = row + 1
        else:
            while heap and len(taken) < need - 1:
                taken.append(heappop(heap))
            if not heap:
                break
            target = max(heap[0][0], row + 1)
        back = []
        for _, k, at in taken:
            at = bisect_left(lists[k], target, at)
            if at < len(lists[k]):
                back.append((lists[k][at], k, at))
        if back:
            heap.extend(back)
            heapify(heap)
    return out


class Inverted:
    """Inverted lists over some sets: shingle -> rows of the sets that hold it, ascending."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        items = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        order = np.argsort(items, kind="stable")
        self.rows = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.tokens, self.start = np.unique(items[order], return_index=True)
        self.end = np.append(self.start[1:], len(items))

    def search(self, query: np.ndarray, percent: int, allowed: np.ndarray | None = None) -> list[int]:
        """Rows (of the allowed ones) whose sets link with ``query``, by T-occurrence."""
        n = len(query)
        ok = 100 * np.minimum(self.sizes, n) >= percent * np.maximum(self.sizes, n)
        if allowed is not None:
            ok &= allowed
        if not ok.any():
            return []
        need = -(-percent * (n + self.sizes) // (100 + percent))
        at = np.minimum(np.searchsorted(self.tokens, query), len(self.tokens) - 1)
        at = at[self.tokens[at] == query]
        lists = [self.rows[a:b] for a, b in zip(self.start[at], self.end[at])]
        if not ok.all():
            lists = [x[ok[x]] for x in lists]
        return [k for k, m in divide_skip(lists, int(need[ok].min())).items() if m >= need[k]]


def search(query: np.ndarray, nodes: list[np.ndarray], percent: int) -> list[int]:
    """Rows of ``nodes`` whose sets link with ``query``."""
    return Inverted(nodes).search(query, percent)


def by_block(rows: DataFrame, columns: str, make, schema: pa.Schema, sql: str) -> DataFrame:
    """``make`` of the rows (tuples of the given columns) of each (list, qb, ib), in tasks of their own."""
    @tidy
    def run(batches):
        key, held = None, []
        for b in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[:3] != key:
                    out += make(key, held) if held else []
                    key, held = row[:3], []
                held.append(row[3:])
            yield to_batch(out, schema)
        yield to_batch(make(key, held) if held else [], schema)

    return rows.select("list", "qb", "ib", *columns.split()).repartition("list", "qb", "ib").sortWithinPartitions("list", "qb", "ib") \
        .mapInArrow(run, sql)


def may_link(held: list[tuple], percent: int) -> np.ndarray:
    """Which rows (comp, query, member, n, parity print) of a block can have a link in it: members with a
    query of another component that their print lets link, and such queries."""
    comp, query, member, n = (np.array(c) for c in list(zip(*held))[:4])
    prints = [np.frombuffer(row[4], "<u8") for row in held]
    wide = np.array([len(x) for x in prints])
    at = {w: np.flatnonzero(member & (wide == w)) for w in np.unique(wide[member]).tolist()}
    of = {(w, w): np.array([prints[k] for k in rows]) for w, rows in at.items()}
    out = np.zeros(len(held), bool)
    for q in np.flatnonzero(query).tolist():
        for w, rows in at.items():
            fit = (comp[rows] != comp[q]) & (100 * np.minimum(n[rows], n[q]) >= percent * np.maximum(n[rows], n[q]))
            if not fit.any():
                continue
            least = min(w, wide[q].item())
            if (w, least) not in of:
                of[w, least] = fold(of[w, w], least)
            rows, both = rows[fit], n[rows[fit]] + n[q]
            differ = np.bitwise_count(of[w, least][fit] ^ fold(prints[q][None], least)).sum(1, dtype=np.int64)
            rows = rows[differ <= both - 2 * -(-percent * both // (100 + percent))]
            out[rows] = True
            out[q] |= len(rows) > 0
    return out


def sieve(asked: DataFrame, prints: DataFrame, percent: int) -> DataFrame:
    """The rows of searches that can have a link in their block (see ``search_blocks``), by the nodes' prints."""
    ship_package(asked.sparkSession)
    asked = cut_lineage(asked)

    def make(key, held):
        return [(*key, *row[:4]) for row, may in zip(held, may_link([row[1:] for row in held], percent)) if may]

    rows = prints.join(small(asked), "node")
    return cut_lineage(by_block(rows, "node comp query member n parity", make, _ASKED, _ASKED_SQL))


def search_blocks(asked: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of searches.

    ``asked``: rows (list, qb, ib, node, comp, query, member).  Rows of one (list, qb, ib) are one
    task's work: an index over the members' sets, searched for every query among the members
    of other components.
    """
    ship_package(asked.sparkSession)

    def make(key, held):
        held = [(node, comp, query, member, np.frombuffer(items, "<u8")) for node, comp, query, member, items in held]
        members = [(node, comp, s) for node, comp, _, member, s in held if member]
        queries = [(node, comp, s) for node, comp, query, _, s in held if query]
        if not members or not queries:
            return []
        index, comps = Inverted([s for *_, s in members]), np.array([c for _, c, _ in members])
        return [(node, members[k][0]) for node, comp, s in queries for k in index.search(s, percent, comps != comp)]

    return by_block(sets.join(small(asked), "node"), "node comp query member items", make, _LINK, "a long, b long")


# -- rounds -----------------------------------------------------------------------


def node_sets(docs: DataFrame, wanted: DataFrame, nameless: DataFrame, width: int) -> DataFrame:
    """node, n, items of the wanted nodes, each from one document (wanted: doc_id); nodes that only
    rows without an id hold (nameless: node) from those rows."""
    def make():
        hashes = WordHashes()

        def run(cols):
            for (text,) in zip(*cols):
                s = shingles(hashes, text, width)
                yield node_of(s), len(s), s.astype("<u8").tobytes()
        return run
    sets = lambda texts: map_rows(texts.select("text"), make, _NODE_SET, "node long, n long, items binary", weigh=lambda r: len(r[2]))
    named = sets(docs.join(small(wanted), "doc_id", "left_semi"))
    if nameless.isEmpty():
        return named
    return named.union(sets(docs.where("doc_id is null")).join(small(nameless), "node", "left_semi").dropDuplicates(["node"]))


def link_nodes(docs: DataFrame, scanned: DataFrame, width: int, percent: int, block: int, short_list: int,
               shared: int) -> DataFrame:
    """(node, comp) of all nodes that link with another (scanned: what ``first_pass`` returns)."""
    spark = docs.sparkSession
    order = spark.sparkContext.broadcast(order_of(scanned))
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    path = scratch_path(spark, "meetings")
    meetings(docs, order, width, percent, max(8, -(-size // _PART_BYTES)), short_list, shared).write.parquet(path)
    met = spark.read.schema(_MEETINGS_SQL).parquet(path)
    lists = cut_lineage(met.where("list <> 0").dropDuplicates(["list", "node"]).select("list", "node"))
    # T-occurrence on prefixes: a pair that meets in short lists only must meet in enough of them
    few = cut_lineage(met.where("list = 0").groupBy("node", "other").agg(F.sum("w").alias("w"), F.max("need").alias("need"))
                      .where("w >= need").select(F.col("node").alias("q"), F.col("other").alias("node")))
    meta = scanned.where("node is not null")
    one = meta.where("doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    nodes = lists.select("node").union(few.select("node")).union(few.select(F.col("q").alias("node"))).distinct()
    prints = cut_lineage(meta.select("node", "n", "parity").join(small(nodes), "node", "left_semi").dropDuplicates(["node"]))

    def sets_of(nodes: DataFrame) -> DataFrame:
        nodes = cut_lineage(nodes)
        wanted = cut_lineage(one.join(small(nodes), "node", "left_semi").select("doc_id"))
        nameless = cut_lineage(meta.where("doc_id is null").select("node").distinct().join(one, "node", "left_anti").join(nodes, "node", "left_semi"))
        path = scratch_path(spark, "sets")
        node_sets(docs, wanted, nameless, width).write.parquet(path)
        return spark.read.schema("node long, n long, items binary").parquet(path)

    # how many meetings a node has: the middle of a group of copies has most
    meets = lists.join(lists.groupBy("list").agg(F.count("*").alias("m")), "list").groupBy("node").agg(F.sum("m").alias("meets"))
    left = cut_lineage(lists.join(meets, "node").withColumn("comp", F.col("node")))
    # round 1: of each list the node that meets most others is searched for among its other nodes;
    # lists with one such node are searched together
    best = left.groupBy("list").agg(F.max(F.struct("meets", "node")).alias("best")).select("list", F.col("best.node").alias("q"))
    met = left.join(best, "list")
    pairs = cut_lineage(met.where("node <> q").select("q", "node").union(few).distinct())
    blocks = pairs.groupBy("q").agg(F.ceil(F.count("*") / block).alias("k"))
    star = pairs.join(blocks, "q").select(F.col("q").alias("list"), F.lit(0).cast("long").alias("qb"), F.pmod(F.xxhash64("node"), F.col("k")).alias("ib"),
                                          "node", F.col("node").alias("comp"), F.lit(False).alias("query"), F.lit(True).alias("member"))
    asks = blocks.select(F.col("q").alias("list"), F.lit(0).cast("long").alias("qb"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("ib"),
                         F.col("q").alias("node"), F.col("q").alias("comp"), F.lit(True).alias("query"), F.lit(False).alias("member"))
    asked = sieve(star.union(asks), prints, percent)
    sets = sets_of(asked.select("node").distinct())
    links = cut_lineage(search_blocks(asked, sets, percent))
    names = components(links)
    # round 2: what is left of each list, unless it is one component; nodes outside its largest
    # component are searched for among all of it
    left = met.where("node <> q").select("list", "node").join(names, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    size = left.groupBy("list", "comp").agg(F.count("*").alias("size"))
    largest = size.groupBy("list").agg(F.max_by("comp", F.struct("size", "comp")).alias("big"), F.sum("size").alias("all"),
                                       F.max("size").alias("most")).where("most < all")
    left = left.join(largest, "list").withColumns({
        "qk": F.ceil((F.col("all") - F.col("most")) / block), "ik": F.ceil(F.col("all") / block),
        "query": F.col("comp") != F.col("big")})
    # a node is a member in one index block, met by every query block, and a query in one block, met by every index block
    qb, ib = F.pmod(F.xxhash64("node"), F.col("qk")), F.pmod(F.xxhash64("node", F.lit(1)), F.col("ik"))
    members = left.select("list", F.explode(F.sequence(F.lit(0).cast("long"), F.col("qk") - 1)).alias("qb"), ib.alias("ib"), "node", "comp",
                          F.lit(False).alias("query"), F.lit(True).alias("member"))
    queries = left.where("query").select("list", qb.alias("qb"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("ik") - 1)).alias("ib"),
                                         "node", "comp", F.lit(True).alias("query"), F.lit(False).alias("member"))
    asked = sieve(members.union(queries), prints, percent)
    new = asked.select("node").distinct().join(sets.select("node"), "node", "left_anti")
    more = cut_lineage(search_blocks(asked, sets.union(sets_of(new)), percent))
    return components(links.union(more)) if not more.isEmpty() else names


def similarity_groups(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, block: int = BLOCK,
                      short_list: int = SHORT_LIST, shared: int = SHARED) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links), and node and comp (the names
    of the text's set and of its component's smallest set; null without shingles) of every document."""
    spark = docs.sparkSession
    own = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    path = scratch_path(spark, "shingle-sets")
    first_pass(own, width).write.parquet(path)
    scanned = spark.read.schema(_SETS_SQL).parquet(path)
    meta = scanned.where("chunk is null").select("doc_id", "n", "node")
    names = link_nodes(own, scanned, width, percent, block, short_list, shared)
    low = meta.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("low")) \
        .join(names, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = low.groupBy("comp").agg(F.min("low").alias("component_id"))
    of_node = low.join(least, "comp").select("node", "component_id", "comp")
    return meta.join(of_node, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "node", "comp")


def with_nodes(docs: DataFrame, text: str, width: int) -> DataFrame:
    """The rows and their nodes."""
    ship_package(docs.sparkSession)
    at = docs.columns.index(text)

    @tidy
    def run(batches):
        hashes = WordHashes()
        for b in batches:
            for first in range(0, b.num_rows, 1000):
                part = b.slice(first, 1000)
                got = [shingles(hashes, t, width) for t in part.column(at).to_pylist()]
                nodes = pa.array([node_of(x) if len(x) else None for x in got], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns, nodes], names=[*part.schema.names, "node"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("node", T.LongType())]))


def keep_one_of_each_group(docs: DataFrame, width: int = WIDTH, **settings) -> DataFrame:
    """One row of every group, of its smallest doc_id; rows without an id as they are.

    Of several rows of that id in the group the smallest node's stays, once.  Only the
    ids that go (those of near copies), and those that several rows have, meet the texts.
    """
    groups = similarity_groups(docs, width=width, **settings)
    path = scratch_path(docs.sparkSession, "groups")
    groups.write.parquet(path)
    groups = docs.sparkSession.read.schema("doc_id long, n_shingles long, component_id long, node long, comp long").parquet(path).where("doc_id is not null")
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    again = groups.groupBy("doc_id").agg(F.count("*").alias("m")).where("m > 1").select("doc_id")
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    key, text = (f"c{docs.columns.index(c)}" for c in ("doc_id", "text"))
    if again.isEmpty():
        return plain.join(small(gone), plain[key] == gone.doc_id, "left_anti").toDF(*docs.columns)
    again = small(again)
    single = plain.join(again, plain[key] == again.doc_id, "left_anti")
    single = single.join(small(gone), single[key] == gone.doc_id, "left_anti")
    # an id of several texts: each is judged by its own node
    stay = groups.where("doc_id = component_id and node is not null").groupBy("comp", "doc_id").agg(F.min("node").alias("one"))
    several = with_nodes(plain.join(again, plain[key] == again.doc_id, "left_semi"), text, width)
    first = several.where("node is not null").join(stay, (F.col(key) == stay.doc_id) & (F.col("node") == stay.one), "left_semi") \
        .dropDuplicates([key, "node"])
    bare = several.where("node is null").dropDuplicates([key, text])
    return single.union(first.drop("node")).union(bare.drop("node")).toDF(*docs.columns)
