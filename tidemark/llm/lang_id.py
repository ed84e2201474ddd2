"""Language identification by rank-order n-gram profiles.

A profile lists a language's most frequent character n-grams (1 to 3 letters of words, word
ends included), most frequent first.  A document's own list is compared with each profile by the
out-of-place distance: the sum over its n-grams of how far their ranks lie apart, or
the profile's length for an n-gram that the profile lacks.  The least distance wins.

Profiles count every training document: tasks count n-grams and Spark adds these up; only the profiles (``profile_size`` rows for each language) come
to the driver.

Defined cases: text that is null or holds no letter gives ``und`` with score 0, as does any
text where there is nothing to learn from; equal counts rank by the n-gram, equal distances go
to the language that sorts first; null ids and repeated rows are answered like any others.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_remainder, map_rows, map_slices, pick, replace

#: Longest n-gram (three letters fit one 64-bit code) and length of a profile.
N_MAX = 3
PROFILE_SIZE = 400
UNKNOWN = "und"
#: n-grams that a task gathers before it counts them, and counts that it holds for a language.
_GATHER = 1 << 20
_HELD = 1 << 18
_BITS = 21
_END = ord("_")

_COUNTS = pa.schema([("lang", pa.string()), ("code", pa.int64()), ("n", pa.int64())])
_PRED = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("margin", pa.float64())])

_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Which code points are letters (made once for each Python worker)."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def gram_codes(text: str | None) -> np.ndarray:
    """Codes of all 1- to 3-grams of a text's words, word ends marked; empty without a letter.

    A code holds the code points from the left, so codes sort as the n-grams do.
    """
    if not text:
        return np.zeros(0, np.int64)
    chars = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    letter = _letters()[chars]
    keep = letter.copy()
    keep[1:] |= letter[:-1]          # the first non-letter after a word is its end
    if not keep.any():
        return np.zeros(0, np.int64)
    s = np.where(letter, chars, _END)[keep]
    s = np.concatenate([[_END], s] if s[-1] == _END else [[_END], s, [_END]])
    inner = s != _END
    pairs = s[:-1] << (2 * _BITS) | s[1:] << _BITS
    return np.concatenate([s[inner] << (2 * _BITS), pairs, (pairs[:-1] | s[2:])[inner[1:-1]]])


def gram_text(code: int) -> str:
    mask = (1 << _BITS) - 1
    return "".join(chr(c) for c in (code >> 2 * _BITS, code >> _BITS & mask, code & mask) if c)


def _add_up(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    all_codes, all_counts = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(all_codes, kind="stable")
    c = all_codes[order]
    first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
    return c[first], np.add.reduceat(all_counts[order], first)


def learn_profiles(labelled: DataFrame, size: int = PROFILE_SIZE) -> dict[str, list[int]]:
    """{language: n-gram codes, most frequent first} from columns text and lang (nulls are skipped)."""
    rows = pick(labelled, "text", "lang").where("text is not null and lang is not null")
    counts = map_rows(rows, _counter, _COUNTS, "lang string, code long, n long")
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    best = (counts.groupBy("lang", "code").agg(F.sum("n").alias("n"))
            .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= size))
    out: dict[str, list[int]] = {}
    for r in best.select("lang", "rank", "code").orderBy("lang", "rank").collect():
        out.setdefault(r.lang, []).append(r.code)
    return out


def _counter():
    held: dict[str, tuple] = {}
    new: dict[str, list] = defaultdict(list)
    size: dict[str, int] = defaultdict(int)

    def count(lang):
        codes, n = np.unique(np.concatenate(new.pop(lang)), return_counts=True)
        size[lang] = 0
        held[lang] = _add_up(*zip(held[lang], (codes, n))) if lang in held else (codes, n)

    def emit(lang):
        codes, n = held.pop(lang)
        yield from zip([lang] * len(codes), codes.tolist(), n.tolist())

    def run(cols):
        for text, lang in zip(*cols):
            codes = gram_codes(text)
            new[lang].append(codes)
            size[lang] += len(codes)
            if size[lang] > _GATHER:
                count(lang)
                if len(held[lang][0]) > _HELD:
                    yield from emit(lang)
        for lang in list(new):
            count(lang)
        for lang in list(held):
            yield from emit(lang)
    return run


class Ranker:
    """Out-of-place distances of a text to all profiles."""

    def __init__(self, profiles: dict[str, list[int]], size: int):
        self.langs, self.size = sorted(profiles), size
        self.codes = np.unique(np.array([c for p in profiles.values() for c in p] or [0], np.int64))
        self.rank = np.full((len(self.langs), len(self.codes) + 1), size, np.int32)
        for k, lang in enumerate(self.langs):
            self.rank[k, np.searchsorted(self.codes, np.array(profiles[lang], np.int64))] = np.arange(len(profiles[lang]))

    def identify(self, text: str | None) -> tuple[str, float, float]:
        """Language, score (1: the profile itself, 0: nothing in common), lead over the next language."""
        return self.measure(text)[:3]

    def measure(self, text: str | None) -> tuple[str, float, float, int]:
        """What ``identify`` returns, and the text's length class: the bits of its number of ranked n-grams."""
        codes, n = np.unique(gram_codes(text), return_counts=True)
        if not len(codes) or not self.langs:
            return UNKNOWN, 0.0, 0.0, 0
        top = codes[np.argsort(-n, kind="stable")[:self.size]]
        at = np.searchsorted(self.codes, top)
        at[self.codes[np.minimum(at, len(self.codes) - 1)] != top] = len(self.codes)
        rank = self.rank[:, at]
        away = np.where(rank < self.size, np.abs(rank - np.arange(len(top), dtype=np.int32)), self.size).sum(1)
        best = int(np.argmin(away))
        worst = self.size * len(top)
        lead = np.delete(away, best).min() - away[best] if len(away) > 1 else worst
        return self.langs[best], float(1 - away[best] / worst), float(lead / worst), len(top).bit_length()


def identify_languages(docs: DataFrame, profiles: dict[str, list[int]], size: int = PROFILE_SIZE) -> DataFrame:
    """doc_id, lang_pred, score, margin of every document, from its text alone."""
    def make():
        ranker = Ranker(profiles, size)
        return lambda cols: ((doc, *ranker.identify(text)) for doc, text in zip(*cols))

    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_rows(rows, make, _PRED, "doc_id long, lang_pred string, score double, margin double")


#: Below this score a text resembles none of the learned languages, whatever their own texts score.
LEAST_SCORE = 0.2
#: Words in the first so many characters of a training text teach what short texts score.
BEGINNINGS = (8, 32, 128)
#: Training scores from which a cut is learned, their low quantile, and the margin below it as a
#: share of the way from there to the median.
LEAST_SCORES = 10
LOW = 0.001
MARGIN = 0.25

_SCORES = pa.schema([("lang", pa.string()), ("length", pa.int64()), ("score", pa.float64())])


def learn_cuts(labelled: DataFrame, profiles: dict[str, list[int]], size: int = PROFILE_SIZE) -> dict[tuple[str, int], float]:
    """{(language, length class): least score of its texts}, from the scores of the training texts and of their
    beginnings; short texts score more unevenly, so their cuts are lower."""
    def make():
        ranker = Ranker(profiles, size)

        def run(cols):
            for (text,) in zip(*cols):
                for part in (text, *(" ".join(text[:n].split()[:-1]) for n in BEGINNINGS if n < len(text))):
                    lang, score, _, length = ranker.measure(part)
                    if length:
                        yield lang, length, score
        return run

    rows = pick(labelled, "text", "lang").where("text is not null and lang is not null").select("text")
    found = map_rows(rows, make, _SCORES, "lang string, length long, score double").groupBy("lang", "length") \
        .agg(F.count("*").alias("n"), F.percentile_approx("score", [LOW, 0.5]).alias("q")).where(F.col("n") >= LEAST_SCORES)
    return {(r.lang, r.length): r.q[0] - MARGIN * (r.q[1] - r.q[0]) for r in found.collect()}


def cut_of(cuts: dict[tuple[str, int], float], lang: str, length: int, least: float = LEAST_SCORE) -> float:
    """The cut of a length class, or of the next shorter one that has one; never below ``least``."""
    return max(least, next((cuts[lang, k] for k in range(length, 0, -1) if (lang, k) in cuts), least))


def keep_known_languages(docs: DataFrame, least: float = LEAST_SCORE, size: int = PROFILE_SIZE) -> DataFrame:
    """The rows whose text is in a learned language, columns as they are; a null lang is filled in.

    Profiles, and the least score of each language's texts, are learned from the rows that have
    text and lang.  Rows without a letter, or that resemble no learned language, go.
    """
    profiles = learn_profiles(docs, size)
    cuts = learn_cuts(docs, profiles, size)
    text_at, lang_at = docs.columns.index("text"), docs.columns.index("lang")

    def make():
        ranker = Ranker(profiles, size)

        def run(b):
            found = [ranker.measure(t) for t in b.column(text_at).to_pylist()]
            lang = [old if old is not None else new for old, (new, *_) in zip(b.column(lang_at).to_pylist(), found)]
            keep = [name != UNKNOWN and score >= cut_of(cuts, name, length, least) for name, score, _, length in found]
            return replace(b, lang_at, lang).filter(pa.array(keep))
        return run

    return map_slices(docs, make)


def held_out():
    """The documents kept from learning: crc32 of doc_id as text leaves 2 modulo 4 (a null id is not)."""
    return F.coalesce(crc_remainder(F.col("doc_id"), 4) == 2, F.lit(False))


def language_table(docs: DataFrame) -> DataFrame:
    """Profiles from the documents not held out, then every document's language."""
    own = pick(docs, "doc_id", "text", "lang")
    return identify_languages(own, learn_profiles(own.where(~held_out()))).withColumn("held_out", held_out())
