"""Encoding and decoding with a SentencePiece file of the merge (BPE) type.

Encoding keeps an agenda of adjacent symbol pairs whose join is in the vocabulary, ordered by
score (ties: leftmost).  The best pair is joined, pairs that it made stale are
skipped when they come up, and the two new neighbours' pairs enter the agenda, until it is
empty.  Symbols outside the vocabulary become their UTF-8 bytes.  The new words of a batch keep their agendas side by
side in one array: each step takes every word's best pair and looks up the two pairs it makes.
A long word has an agenda of its own, a heap.

No piece of such a vocabulary holds a word mark after another character, so no join
crosses the start of a word: a text's ids are its words' ids in order, and each task keeps
those of the words it has met.  Both facts are read off the file when it is opened.

Everything is checked against the sentencepiece library, a batch at a time: each distinct word's ids
when it enters the table, the ids of every text that isn't split into words at single blanks, and
every text decoded from its ids.  Where something differs the library's answer is taken and the row says so.

Null text is empty (begin and end ids only); null doc ids and repeated rows are encoded like
any others; other columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import re
from array import array
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_rows, pick
from .token_cache import LONGEST, _Group, _Table

MARK = "▁"
_WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
_OPEN: dict[str, "PieceModel"] = {}

SCHEMA = "doc_id long, ids binary, decoded string, differs boolean"
_ARROW = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string()), ("differs", pa.bool_())])
#: Characters of texts that are checked in one batch.
_BATCH_CHARS = 1 << 20


class Agendas:
    """The agendas of many words at once."""

    def __init__(self, cost: dict[str, float], ids: dict[str, int], size: int):
        self.size = size
        self.symbol = np.arange(0x110000, dtype=np.int64) + size
        for piece, i in ids.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = i
        order = np.unique(np.array(list(cost.values())), return_inverse=True)[1]
        self.order = np.zeros(size, np.int64)
        self.order[[ids[p] for p in cost]] = order
        part = lambda s: ids.get(s, size + ord(s) if len(s) == 1 else None)
        pairs = [(a << 21 | b, ids[p]) for p in cost for k in range(1, len(p))
                 if (a := part(p[:k])) is not None and (b := part(p[k:])) is not None]
        keys, joins = (np.array(x, np.int64) for x in zip(*sorted(pairs)))
        # an open table: a key stands at its place or one of the next few
        self.bits = max(8, (4 * len(keys)).bit_length())
        self.keys, self.joins = np.full((1 << self.bits) + len(keys), -1), np.full((1 << self.bits) + len(keys), -1)
        at, self.probes = self._place(keys), 0
        left = np.arange(len(keys))
        while len(left):
            here = at[left] + self.probes
            free = self.keys[here] < 0
            took = np.unique(here[free], return_index=True)[1]
            put = left[np.flatnonzero(free)[took]]
            self.keys[at[put] + self.probes], self.joins[at[put] + self.probes] = keys[put], joins[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            self.probes += 1

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What pairs of symbols join to; -1 where that isn't in the vocabulary."""
        keys = a << 21 | b
        at = self._place(keys)
        out = np.where(self.keys[at] == keys, self.joins[at], -1)
        left = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] >= 0))
        for k in range(1, self.probes):
            if not len(left):
                break
            here = at[left] + k
            hit = self.keys[here] == keys[left]
            out[left[hit]] = self.joins[here[hit]]
            left = left[~hit & (self.keys[here] >= 0)]
        return out

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(symbols of all words one after another, how many each word has)."""
        many = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.symbol[np.frombuffer("".join(words).encode("utf-32-le"), "<u4")]
        word = np.repeat(np.arange(len(words)), many)
        never = np.iinfo(np.int64).max
        last = np.append(word[1:] != word[:-1], True)
        joined = np.full(len(sym), -1)
        joined[:-1] = self.join(sym[:-1], sym[1:])
        joined[last] = -1
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            # the agenda: the pair's order, then its place
            key = np.where(joined >= 0, self.order[joined] << 32 | np.arange(len(sym)), never)
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.minimum.reduceat(key, first)
            busy = best < never
            if not busy.all():
                whole = np.repeat(~busy, np.diff(np.append(first, len(sym))))
                done.append((word[whole], sym[whole]))
            at = best[busy] & 0xFFFFFFFF
            sym[at] = joined[at]
            keep = np.repeat(busy, np.diff(np.append(first, len(sym))))
            keep[at + 1] = False
            # the two pairs that each join made, told by where their left symbols go
            place = np.cumsum(keep) - 1
            at = place[at]
            sym, word, joined = sym[keep], word[keep], joined[keep]
            if not len(sym):
                break
            last = np.append(word[1:] != word[:-1], True)
            for left in (at, at[(at > 0)] - 1):
                left = left[~last[left]]
                joined[left] = self.join(sym[left], sym[left + 1])
            joined[last] = -1
        word, sym = (np.concatenate(x) for x in zip(*done)) if done else (word, sym)
        sym = sym[np.argsort(word, kind="stable")]
        return sym, np.bincount(word, minlength=len(words))


def blanks_alone(text: str) -> bool:
    """Whether the text is words with one blank between them."""
    return bool(text) and not (text[0] == " " or text[-1] == " " or "  " in text or MARK in text)


class PieceModel:
    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb
        with open(path, "rb") as f:
            raw = f.read()
        m = pb.ModelProto()
        m.ParseFromString(raw)
        norm, kinds = m.normalizer_spec, pb.ModelProto.SentencePiece
        usual = {kinds.NORMAL, kinds.BYTE, kinds.CONTROL, kinds.UNKNOWN}
        if (m.trainer_spec.model_type != pb.TrainerSpec.BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces
                or not (norm.add_dummy_prefix and norm.escape_whitespaces) or not m.trainer_spec.byte_fallback
                or any(p.type not in usual for p in m.pieces)
                or any(re.search(f"[^{MARK}]{MARK}", p.piece) for p in m.pieces)):
            raise ValueError("a merge-type vocabulary with identity normalisation, byte fallback and marks in front is needed")
        self.library = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.cost = {p.piece: -p.score for p in m.pieces if p.type == kinds.NORMAL}
        self.id = {p.piece: i for i, p in enumerate(m.pieces) if p.type == kinds.NORMAL}
        self.byte_id = [0] * 256
        self.shown = []
        for i, p in enumerate(m.pieces):
            if p.type == kinds.BYTE:
                self.byte_id[int(p.piece[1:-1], 16)] = i
                self.shown.append(bytes([int(p.piece[1:-1], 16)]))
            else:
                self.shown.append(b"" if p.type == kinds.CONTROL else p.piece.replace(MARK, " ").encode())
        self.begin, self.end = self.library.bos_id(), self.library.eos_id()
        self.marked = [p.piece.startswith(MARK) for p in m.pieces]
        self.agendas = Agendas(self.cost, self.id, len(m.pieces))
        group = _Group()
        self.words = _Table(self._word, group)
        self.after_blank = _Table(lambda w: self._word(MARK + w), group)
        #: Words whose ids differ from the library's, which are in the table instead.
        self.wrong: set[str] = set()

    def clear(self):
        self.words.clear()
        self.after_blank.clear()
        self.wrong.clear()

    def merge(self, word: str) -> list[str]:
        """The symbols left when no adjacent pair joins to a piece."""
        cost, sym, n = self.cost, list(word), len(word)
        agenda = [(cost[j], i, i + 1, j) for i in range(n - 1) if (j := sym[i] + sym[i + 1]) in cost]
        heapify(agenda)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        while agenda:
            _, a, b, joined = heappop(agenda)
            if not sym[b] or not sym[a] or len(sym[a]) + len(sym[b]) != len(joined):
                continue
            sym[a], sym[b] = joined, ""
            right[a] = after = right[b]
            if after < n:
                left[after] = a
                if (j := joined + sym[after]) in cost:
                    heappush(agenda, (cost[j], a, after, j))
            if (before := left[a]) >= 0 and (j := sym[before] + joined) in cost:
                heappush(agenda, (cost[j], before, a, j))
        return [s for s in sym if s]

    def words_at_once(self, words: list[str]) -> list[bytes]:
        """Ids of several words."""
        short = [w for w in words if len(w) <= LONGEST + 1]
        sym, many = self.agendas.merge(short) if short else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        ends = np.cumsum(many)
        cut = [0, *(4 * ends).tolist()]
        outside = np.unique(np.searchsorted(ends, np.flatnonzero(sym >= self.agendas.size), "right")).tolist()
        data = sym.astype("<u4").tobytes()
        ids = [data[a:b] for a, b in zip(cut, cut[1:])]
        for k in outside:
            own = array("I")
            for s in sym[cut[k] // 4:cut[k + 1] // 4].tolist():
                if s < self.agendas.size:
                    own.append(s)
                else:
                    own.extend(self.byte_id[b] for b in chr(s - self.agendas.size).encode())
            ids[k] = own.tobytes()
        if len(short) == len(words):
            return ids
        short_ids = iter(ids)
        return [next(short_ids) if len(w) <= LONGEST + 1 else self._word(w) for w in words]

    def _word(self, word: str) -> bytes:
        ids = array("I")
        for s in self.merge(word):
            i = self.id.get(s)
            if i is not None:
                ids.append(i)
            else:
                ids.extend(self.byte_id[b] for b in s.encode())
        return ids.tobytes()

    def encode(self, text: str | None) -> bytes:
        """Begin id, the text's ids, end id, as little-endian unsigned 32-bit integers."""
        ends = array("I", [self.begin, self.end]).tobytes()
        if not text:
            return ends
        if blanks_alone(text):
            body = map(self.after_blank.__getitem__, text.split(" "))
        else:
            body = map(self.words.__getitem__, _WORD.findall(MARK + text.replace(" ", MARK)))
        return b"".join((ends[:4], *body, ends[4:]))

    def learn(self, words: set[str]) -> list[str]:
        """Puts all words (that a blank goes before) into the table, new ones compared with the library's;
        returns those too long to stay there."""
        table = self.after_blank
        table.make_room()
        missing = words.difference(table)
        known = missing.intersection(table.older)
        table.keep_all(known, [table.older[w] for w in known])
        new = list(missing.difference(known))
        ids = self.words_at_once([MARK + w for w in new])
        theirs = self.library.encode(new, num_threads=1)
        flat = np.fromiter(chain.from_iterable(theirs), "<u4").tobytes()
        if b"".join(ids) != flat or any(len(x) != 4 * len(y) for x, y in zip(ids, theirs)):
            for k, (w, y) in enumerate(zip(new, theirs)):
                y = array("I", y).tobytes()
                if ids[k] != y:
                    self.wrong.add(w)
                    ids[k] = y
        table.keep_all(new, ids)
        return [w for w in new if len(w) > LONGEST]

    def encode_checked(self, texts: list[str]) -> list[tuple[bytes, bool]]:
        """Ids of texts, and whether the dealt method's differ from the library's."""
        begin, end = (array("I", [i]).tobytes() for i in (self.begin, self.end))
        split = [t.split(" ") if blanks_alone(t) else None for t in texts]
        long = self.learn(set().union(*filter(None, split)))
        odd = [t for t, w in zip(texts, split) if w is None]
        theirs = iter(self.library.encode(odd, add_bos=True, add_eos=True, num_threads=1) if odd else ())
        out = []
        for t, words in zip(texts, split):
            if words is not None:
                ids = b"".join((begin, *map(self.after_blank.__getitem__, words), end))
                out.append((ids, bool(self.wrong) and not self.wrong.isdisjoint(words)))
            else:
                ids = array("I", next(theirs)).tobytes()
                out.append((ids, ids != self.encode(t)))
        for w in long:
            self.after_blank.group.held -= len(w) + len(self.after_blank.pop(w))
        return out

    def decode(self, ids: bytes) -> str:
        """The text of encoded ids: marks are blanks, and the blank put in front goes."""
        body = np.frombuffer(ids, "<u4").tolist()
        data = b"".join(map(self.shown.__getitem__, body))
        first = next((i for i in body if i not in (self.begin, self.end)), None)
        return data[1 if first is not None and self.marked[first] else 0:].decode("utf-8", "replace")


def model(path: str) -> PieceModel:
    if path not in _OPEN:
        _OPEN[path] = PieceModel(path)
    return _OPEN[path]


def checked(m: PieceModel, docs: list, texts: list):
    """(doc, ids, decoded, differs) of each text."""
    first = 0
    while first < len(texts):
        last, chars = first, 0
        while last < len(texts) and chars < _BATCH_CHARS:
            chars += len(texts[last] or "")
            last += 1
        encoded = m.encode_checked([t or "" for t in texts[first:last]])
        theirs = m.library.decode([np.frombuffer(ids, "<u4").tolist() for ids, _ in encoded], num_threads=1)
        for doc, (ids, differs), decoded in zip(docs[first:last], encoded, theirs):
            yield doc, ids, decoded, differs or decoded != m.decode(ids)
        first = last


def piece_round_trip(docs: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: its ids, the text decoded from them, and whether the library had to correct either."""
    def make():
        m = model(model_path)

        def run(cols):
            return checked(m, *cols)
        run.clear = m.clear
        return run

    rows = pick(docs, id_column, text_column).selectExpr(f"cast({id_column} as long) {id_column}", text_column)
    return map_rows(rows, make, _ARROW, SCHEMA, weigh=lambda r: 64 + len(r[1]) + len(r[2]))
