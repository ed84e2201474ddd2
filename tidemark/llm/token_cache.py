"""Encoding whole texts with a ``tokenizers`` file, word by word.

Byte-level and word-end BPE split a text at white space before merging, so the ids of a
text are those of its words one after another.  Words repeat far more often than texts,
so a worker keeps the ids of the words it has met (a table of bounded bytes, in two
generations, of the tokenizer used last) and asks the library's model only for new ones.  A text that holds an added token's
string, or white space other than blank, tab and line ends, goes to the library whole.
"""

from __future__ import annotations

import re
from array import array
from itertools import takewhile
from os.path import commonprefix

import numpy as np
import regex

from .common import hold

#: White space beyond the four kinds at which texts are cut here.
_OTHER_SPACE = re.findall(r"[^\S \t\n\r]", "".join(map(chr, range(0x10000))))
_OTHER_SPACE_ASCII = [c for c in _OTHER_SPACE if c.isascii()]
_CHUNK = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
#: Bytes that a generation of an encoder's tables may hold together unless told otherwise, with ``_ENTRY`` for an entry itself;
#: a longer word is not kept.
GENERATION = 160 << 20
_ENTRY = 190
LONGEST = 64

#: How the two kinds of file split a text into pieces before merging.
_BYTE_LEVEL_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WORD_END_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Byte-level names: a visible Latin-1 byte is its own name, the others follow from 256 on.
_VISIBLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_NAMES = dict(zip((b for b in range(256) if b not in _VISIBLE), range(256, 512)))
#: Characters below these (Latin blocks) are split here; others by the library.
_BEYOND_LATIN = re.compile("[\u0250-\U0010ffff]").search
#: Marks that are neither letters, digits nor blanks, and begin no contraction.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_BLANK = chr(_BYTE_NAMES[32])

_OPEN: dict[str, "WordEncoder"] = {}


class _Names(dict):
    """Character -> names of its UTF-8 bytes; those of the Latin blocks are kept."""

    def __missing__(self, c):
        return c.encode().decode("latin-1").translate(_BYTE_NAMES)


_NAMES = _Names()
_NAMES.update((c, _NAMES[c]) for c in map(chr, range(0x250)))


def _has_other_space(text: str) -> bool:
    """Whether a text holds any of these; looking for each is faster than a pattern that looks at every character."""
    for c in _OTHER_SPACE_ASCII if text.isascii() else _OTHER_SPACE:
        if c in text:
            return True
    return False


class _Group(list):
    """Tables that share their bytes."""

    held = 0


class _Table(dict):
    """Word -> ids; computes what is missing.  Tables of one ``group`` share its bytes, and all drop their older half when these
    are used up."""

    limit: int | None = None

    def __init__(self, compute, group: _Group):
        super().__init__()
        self.compute, self.older, self.group = compute, {}, group
        group.append(self)

    def __missing__(self, word):
        ids = self.older.get(word)
        if ids is None:
            ids = self.compute(word)
        if len(word) <= LONGEST:
            group = self.group
            if group.held >= (self.limit or GENERATION):
                self.make_room()
            group.held += _ENTRY + len(word) + len(ids)
            self[word] = ids
        return ids

    def make_room(self):
        if self.group.held >= (self.limit or GENERATION):
            for t in self.group:
                t.older = dict(t)
                dict.clear(t)
            self.group.held = 0

    def keep_all(self, words, ids):
        """Many words at once; the table may grow beyond its bytes until ``make_room``."""
        self.update(zip(words, ids))
        self.group.held += _ENTRY * len(words) + sum(map(len, words)) + sum(map(len, ids))

    def clear(self):
        """Empties this table; a group is emptied as a whole."""
        super().clear()
        self.older, self.group.held = {}, 0


class WordEncoder:
    """Ids as little-endian unsigned 32-bit integers in one bytes object per text.

    They are those of the library's ``encode(text, add_special_tokens=False)``.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        # the strings of added tokens, in any case (a normaliser may fold it), and how all of them begin
        added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)", re.IGNORECASE)
        self.added_start = "".join(takewhile(lambda c: c in _MARKS, commonprefix(added)))
        self.model, self.splitter = self.tok.model, self.tok.pre_tokenizer
        self.tokenize = self.model.tokenize
        # with a normaliser that folds white space, blanks belong to no word
        self.drops_space = self.tok.normalizer is not None
        self.pattern = regex.compile(_WORD_END_SPLIT if self.drops_space else _BYTE_LEVEL_SPLIT)
        self.tables = _Group()
        self.first = _Table(self._chunk, self.tables)
        self.after_blank = _Table(self._word, self.tables)
        self.pieces = _Table(self._piece, self.tables)

    def clear(self):
        for table in self.tables:
            table.clear()

    def _word(self, word: str) -> bytes:
        """Ids of a word that a blank goes before."""
        if not word:
            return self._piece(" ")
        if word.isascii() or not _BEYOND_LATIN(word):
            # letters are one piece, and so are the marks after them
            if word.isalpha():
                return self._piece(" " + word)
            stem = word.rstrip(_MARKS)
            if stem.isalpha():
                return self.after_blank[stem] + self.pieces[word[len(stem):]]
        return self._chunk(" " + word)

    def _piece(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():
            name = piece.replace(" ", _BLANK)
        else:
            name = "".join(map(_NAMES.__getitem__, piece))
        return array("I", [t.id for t in self.tokenize(name)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if self.drops_space:
            low = chunk.lower()
            stem = low.rstrip(_MARKS)
            if stem.isalpha() and (low.isascii() or not _BEYOND_LATIN(low)):
                # a word's forms share the ids of its letters in lower case
                ids = self._piece(stem) if stem == chunk else self.first[stem]
                return ids + self.pieces[low[len(stem):]] if len(stem) < len(low) else ids
        if chunk.isascii() or not _BEYOND_LATIN(chunk):
            # letters, digits and their lower case are the same here in any Unicode version
            if self.drops_space:
                chunk = chunk.lower()
            return b"".join(map(self.pieces.__getitem__, self.pattern.findall(chunk)))
        if self.drops_space:
            chunk = self.tok.normalizer.normalize_str(chunk)
        ids = [t.id for piece, _ in self.splitter.pre_tokenize_str(chunk) for t in self.model.tokenize(piece)]
        return np.array(ids, dtype="<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if _has_other_space(text) or self.added_start in text and self.added.search(text):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if self.drops_space:
            return b"".join(map(self.first.__getitem__, text.split()))
        if "  " in text or " \n" in text or " \t" in text or " \r" in text or text[-1] == " ":
            return b"".join(map(self.first.__getitem__, _CHUNK.findall(text)))
        if "\n\n" in text or "\n\t" in text or "\t\n" in text or "\r" in text:
            return self._line(text)
        # a line end that no other white space but a blank follows is a piece of its own
        return self.pieces["\n"].join(map(self._line, text.split("\n")))

    def _line(self, line: str) -> bytes:
        head, *rest = line.split(" ")
        return (self.first[head] if head else b"") + b"".join(map(self.after_blank.__getitem__, rest))


def encoder(path: str, limit: int | None = None) -> WordEncoder:
    """The worker's encoder for a file, its tables bounded by ``limit`` bytes a generation; the words of another file's go."""
    for other, held in _OPEN.items():
        if other != path:
            held.clear()
    if path not in _OPEN:
        _OPEN[path] = WordEncoder(path)
        hold(_OPEN[path].clear)
    for table in _OPEN[path].tables:
        table.limit = limit
    return _OPEN[path]
