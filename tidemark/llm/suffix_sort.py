"""Suffix arrays by induced sorting, and permuted longest common prefixes, of one shard's bytes.

Suffixes are classified as smaller (S) or larger (L) than their right neighbour.  The leftmost S of
every S run begins a substring; the substrings are sorted by inducing L suffixes from them and S
suffixes from the L ones, and get names; if names repeat, the string of names is sorted the
same way; the sorted beginnings then induce the order of all suffixes.

With a small alphabet a bucket is induced at once: the suffixes known on arrival, then the ones of
the same first character that they put there, wave by wave, each wave dealt to its buckets by a
stable sort of characters.  This is the order a scan of one suffix at a time gives.  Strings of
names have many small buckets and are scanned one suffix at a time.
"""

from __future__ import annotations

import numpy as np

#: Alphabets up to this size are induced bucket by bucket.
SMALL_ALPHABET = 1024


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes of ``s`` (non-negative integers), in order."""
    if len(s) == 0:
        return np.zeros(0, np.int64)
    t = np.append(s.astype(np.int64) + 1, 0)
    return _sort(t, int(t.max()) + 1)[1:]


def _sort(s: np.ndarray, size: int) -> np.ndarray:
    """Suffixes of ``s``, whose last character is its only 0; characters are below ``size``."""
    small = _small_types(s)
    first = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    induce = _induce_buckets if size <= SMALL_ALPHABET else _induce_scan
    if len(first) > 1:
        is_first = np.zeros(len(s), bool)
        is_first[first] = True
        order = induce(s, small, first, size)
        order = order[is_first[order]]
        name_of, names = _names(s, first, order)
        if names < len(first):
            order = first[_sort(name_of, names)]
    else:
        order = first
    return induce(s, small, order, size)


def _small_types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its right neighbour (the last one counts as such)."""
    ends = np.flatnonzero(np.append(s[1:] != s[:-1], True))
    nxt = np.append(s[1:], 0)[ends]
    kind = s[ends] < nxt
    kind[-1] = True
    return np.repeat(kind, np.diff(np.append(-1, ends)))


def _names(s: np.ndarray, first: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the substrings in text order (equal substrings, equal names) and their number."""
    length = np.zeros(len(s), np.int64)
    length[first[:-1]] = np.diff(first) + 1
    length[first[-1]] = 1
    a, b = order[:-1], order[1:]
    same = length[a] == length[b]
    left = np.flatnonzero(same)
    at = 0
    while len(left):
        left = left[length[a[left]] > at]
        differ = s[a[left] + at] != s[b[left] + at]
        same[left[differ]] = False
        left = left[~differ]
        at += 1
    rank = np.zeros(len(s), np.int64)
    rank[order] = np.concatenate([[0], np.cumsum(~same)])
    return rank[first], int(rank[order[-1]]) + 1


def _deal(where: np.ndarray, chars: np.ndarray, buckets: list[list]) -> None:
    """Each position goes to its character's bucket, in the order given."""
    o = np.argsort(chars, kind="stable")
    chars, where = chars[o], where[o]
    cut = np.flatnonzero(chars[1:] != chars[:-1]) + 1
    for c, part in zip(chars[np.append(0, cut)].tolist(), np.split(where, cut)):
        buckets[c].append(part)


def _induce_buckets(s: np.ndarray, small: np.ndarray, seeds: np.ndarray, size: int) -> np.ndarray:
    s = s.astype(np.uint16)
    none = np.zeros(0, np.int64)
    own: list[list] = [[] for _ in range(size)]
    _deal(seeds, s[seeds], own)
    large: list = [[] for _ in range(size)]
    for c in range(size):
        wave = np.concatenate(large[c]) if large[c] else none
        whole = [wave]
        while len(wave):
            before = wave[wave > 0] - 1
            before = before[~small[before]]
            chars = s[before]
            same = chars == c
            if not same.all():
                _deal(before[~same], chars[~same], large)
            wave = before[same]
            whole.append(wave)
        large[c] = np.concatenate(whole)
        for part in own[c]:
            before = part[part > 0] - 1
            if len(before):
                _deal(before, s[before], large)
    less: list = [[] for _ in range(size)]
    less[0] = [seeds[s[seeds] == 0]]
    out: list = [none] * size
    for c in range(size - 1, -1, -1):
        wave = np.concatenate(less[c]) if less[c] else none
        whole = [wave]
        while len(wave) and c:
            before = wave[wave > 0] - 1
            before = before[small[before]]
            chars = s[before]
            same = chars == c
            if not same.all():
                _deal(before[~same], chars[~same], less)
            wave = before[same]
            whole.append(wave)
        whole = np.concatenate(whole)
        back = large[c][::-1]
        before = back[back > 0] - 1
        before = before[small[before]]
        if len(before):
            _deal(before, s[before], less)
        out[c] = np.concatenate([large[c], whole[::-1]])
    return np.concatenate(out)


def _induce_scan(s: np.ndarray, small: np.ndarray, seeds: np.ndarray, size: int) -> np.ndarray:
    ends = np.cumsum(np.bincount(s, minlength=size))
    sa = [-1] * len(s)
    tail = ends.tolist()
    for i, c in zip(seeds[::-1].tolist(), s[seeds[::-1]].tolist()):
        tail[c] = at = tail[c] - 1
        sa[at] = i
    # the character before each position if its suffix is to be put there, else -1; the last entry is an empty place's
    before = np.full(len(s) + 1, -1, np.int64)
    before[1:-1] = np.where(small[:-1], -1, s[:-1])
    at_large = before.tolist()
    before[1:-1] = np.where(small[:-1], s[:-1], -1)
    at_small = before.tolist()
    head = np.append(0, ends[:-1]).tolist()
    for i in sa:
        if (c := at_large[i]) >= 0:
            at = head[c]
            sa[at] = i - 1
            head[c] = at + 1
    tail = ends.tolist()
    for i in reversed(sa):
        if (c := at_small[i]) >= 0:
            tail[c] = at = tail[c] - 1
            sa[at] = i - 1
    sa[0] = len(s) - 1
    return np.array(sa, np.int64)


def permuted_common_prefixes(s: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each position, how long its suffix agrees with the suffix just before it in ``sa``.

    A value is one less than its left neighbour's wherever both suffixes follow the same
    character; the others are compared outright, eight bytes at a time, and the rest filled in.
    """
    n = len(s)
    if n == 0:
        return np.zeros(0, np.int64)
    phi = np.empty(n, np.int64)
    phi[sa[1:]], phi[sa[0]] = sa[:-1], -1
    here = np.arange(n)
    start = (phi <= 0) | (here == 0)
    start[~start] = s[here[~start] - 1] != s[phi[~start] - 1]
    i = np.flatnonzero(start & (phi >= 0))
    # past the end the two sides differ, however far one looks
    data = np.concatenate([s, np.zeros(16, np.uint8)])
    a, b, got = i, phi[i], np.zeros(len(i), np.int64)
    left = np.arange(len(i))
    words = np.lib.stride_tricks.sliding_window_view(data, 8)
    while len(left):
        x, y = a[left] + got[left], b[left] + got[left]
        room = n - np.maximum(x, y)
        diff = words[x].view(np.uint64).ravel() ^ words[y].view(np.uint64).ravel()
        low = diff & (~diff + np.uint64(1))
        agree = np.where(diff == 0, 8, (np.log2(low.astype(np.float64), where=low > 0, out=np.zeros(len(low))) // 8).astype(np.int64))
        step = np.minimum(agree, np.maximum(room, 0))
        got[left] += step
        left = left[step == 8]
    value = np.full(n, -1, np.int64)
    value[i] = got
    value[phi < 0] = 0
    # a reducible value is its irreducible left neighbour's, less the distance
    known = np.maximum.accumulate(np.where(value >= 0, here, 0))
    return np.where(phi < 0, 0, np.maximum(value[known] - (here - known), 0))
