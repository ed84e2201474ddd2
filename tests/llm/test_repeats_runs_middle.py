"""Suffix-array repeats, fill-in-the-middle and periodic runs against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import fill_middle, periodic_runs, queries, repeats, suffix_sort

SF = "/root/testdata/sf0.001"
ROWS = [
    (1, "one two three one two three one two three one two three four"),
    (2, None),
    (3, ""),
    (4, " \n\t "),
    (5, "a a a a a a"),
    (5, "a a a a a a"),
    (6, "é" * 900 + " 日本 🎉 " * 300),
    (6, "other text of one id"),
    (None, "one two three one two three one two three one two three four"),
    (7, "marks <P> and <M> inside"),
    (8, "a b a b a b a b a b a b a\u0085b"),
]


@pytest.fixture(scope="module")
def messy(spark):
    """Nulls, empty and long texts, repeated rows and ids, and columns named like the operators' own."""
    rows = [(*r, "T", b"\x01", 7, 1) for r in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, TEXT string, kept binary, n long, runs int")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


# -- suffix sorting -----------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=80), st.booleans())
def test_induced_sorting_and_common_prefixes(values, scan):
    s = np.array(values, np.uint8)
    b = s.tobytes()
    old = suffix_sort.SMALL_ALPHABET
    suffix_sort.SMALL_ALPHABET = 0 if scan else old
    try:
        sa = suffix_sort.suffix_array(s)
    finally:
        suffix_sort.SMALL_ALPHABET = old
    assert sa.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
    got = suffix_sort.permuted_common_prefixes(s, sa)
    for x, y in zip(sa[1:].tolist(), sa[:-1].tolist()):
        k = 0
        while max(x, y) + k < len(b) and b[x + k] == b[y + k]:
            k += 1
        assert got[x] == k


def test_suffix_array_of_text(spark):
    text = "\n".join(r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()).encode()[:60000]
    sa = suffix_sort.suffix_array(np.frombuffer(text, np.uint8))
    assert sorted(sa.tolist()) == list(range(len(text)))
    assert all(text[a:a + 3000] <= text[b:b + 3000] for a, b in zip(sa[:-1].tolist(), sa[1:].tolist()))


# -- repeats -------------------------------------------------------------------------


def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    count = Counter(b[i:i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i:i + length]] > 1:
                gone[i:i + length] = b"\x01" * length
        spans = len(re.findall(b"\x01+", bytes(gone)))
        out.append((len(b), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return out


def planted_texts(seed, length):
    rnd = random.Random(seed)
    word = lambda n: "".join(rnd.choice("abcdé \n") for _ in range(n))
    base = word(20 * length)
    texts = [None, "", word(length - 1), "x" * 15 * length, "ab" * 10 * length, base, base]
    for _ in range(50):
        t = ""
        for _ in range(rnd.randint(1, 6)):
            if rnd.random() < 0.5:
                a = rnd.randint(0, 15 * length)
                t += base[a:a + rnd.randint(1, 5 * length)]
            else:
                t += word(rnd.randint(1, 3 * length))
        texts.append(t)
    return texts


@pytest.mark.parametrize("shard_bytes", [1 << 21, 256])
def test_repeats_equal_brute_force(spark, shard_bytes):
    """With small shards most anchors are too common for one, and windows are counted."""
    texts = planted_texts(4, 20)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_spans, bytes(r.kept)) for r in repeats.remove_repeats(docs, 20, shard_bytes).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts, 20)


def test_repeats_over_pieces_of_a_long_text(spark, monkeypatch):
    """A text longer than what is hashed at once is taken in overlapping pieces."""
    rnd = random.Random(9)
    long = "".join(rnd.choice("abcdefgh ") for _ in range(5000))
    texts = [long, long[700:2500] + "#" + long[100:300], "z" + long[2400:2460], None]
    monkeypatch.setattr(repeats, "_AT_ONCE", 512)
    pieces = list(repeats._pieces(np.array([0, 5000, 5100, 5200, 9000]), 30))
    assert pieces[0] == (0, 1, 0, 541) and (1, 3, 5000, 5200) in pieces and pieces[-1][3] == 9000
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_spans, bytes(r.kept)) for r in repeats.remove_repeats(docs, 30).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts, 30)


def test_every_window_is_in_one_segment():
    rnd = np.random.default_rng(2)
    data = rnd.integers(97, 99, 4000).astype(np.uint8)
    data[500:900] = 97
    anchors = repeats.Anchors(60)
    valid = np.ones(4000 - 59, bool)
    valid[1000:1059] = False
    start, windows, anchor = anchors.segments(data, valid)
    covered = np.zeros(len(valid), int)
    names = {}
    for s, w, h in zip(start.tolist(), windows.tolist(), anchor.tolist()):
        covered[s:s + w] += 1
        for i in range(s, s + w):
            assert names.setdefault(data[i:i + 60].tobytes(), h) == h
    assert (covered == valid).all()


def test_repeats_odd_rows(spark, messy, empty):
    got = repeats.remove_repeats(messy, 50).collect()
    want = Counter(zip((r[0] for r in ROWS), brute_repeats([r[1] for r in ROWS], 50)))
    assert Counter((r.doc_id, (r.n_bytes, r.n_spans, bytes(r.kept))) for r in got) == want
    assert repeats.remove_repeats(empty).collect() == []
    with pytest.raises(ValueError):
        repeats.remove_repeats(messy, 1)


def test_op11_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.QUERIES["op11_suffix_array_repeats"](spark, SF).collect()}
    for d, (n, spans, kept) in zip(docs, brute_repeats([d.text for d in docs], 400)):
        assert got[d.doc_id] == (n, n - len(kept), spans, hashlib.sha256(kept).hexdigest())


# -- fill in the middle ------------------------------------------------------------------


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 9), max_size=700), st.data())
def test_skip_list_reaches_every_rank(sizes, data):
    ends = np.cumsum(np.array(sizes, np.int64))
    lanes = fill_middle.SkipList(ends, len(sizes), fill_middle.Heights())
    rank = data.draw(st.integers(0, len(sizes)))
    assert lanes.find(rank) == sum(sizes[:rank])
    assert fill_middle.SkipList(None, len(sizes), fill_middle.Heights()).find(rank) == rank
    with pytest.raises(ValueError):
        lanes.find(len(sizes) + 1)


def test_skip_list_takes_few_links():
    heights = fill_middle.Heights()
    lanes = heights.upto(100_000)
    assert [len(x) for x in lanes] == sorted((len(x) for x in lanes), reverse=True)
    assert 4000 < len(lanes[0]) < 9000 and len(lanes[-1]) <= 2


def by_hand(doc_id, text, unit=None):
    text = text or ""
    h = [int(hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * k:8 * k + 8], 16) for k in range(4)]
    units = list(text) if unit is None else re.findall(unit, text)
    n = len(units)
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit", [None, r"\S+\s*|\s+"])
def test_fill_in_middle_equals_slices(messy, unit):
    rows = fill_middle.fill_in_middle(messy, unit=unit)
    got = rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()
    assert Counter(map(tuple, got)) == Counter(by_hand(d, t, unit) for d, t in ROWS)


def test_fill_in_middle_can_be_undone(spark, messy, empty):
    pieces = ["<", "P", ">", "<S", "S>", "M", "x", "é🎉", "<P", "\n"]
    rnd = random.Random(5)
    rows = [(i, "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 12)))) for i in range(400)]
    for docs, texts in ((messy, ROWS), (spark.createDataFrame(rows, "doc_id long, text string"), rows)):
        back = fill_middle.fill_in_middle(docs).select("doc_id", fill_middle.restored(F.col("form"), F.col("output")).alias("t"))
        assert Counter(map(tuple, back.collect())) == Counter((d, t or "") for d, t in texts)
    forms = fill_middle.fill_in_middle(spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text")))
    share = {r.form: r["count"] / 2000 for r in forms.groupBy("form").count().collect()}
    assert abs(share["plain"] - 0.1) < 0.03 and abs(share["spm"] - 0.18) < 0.04
    assert fill_middle.fill_in_middle(empty).collect() == []


# -- periodic runs ---------------------------------------------------------------------


def brute_runs(w):
    n, seen = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                seen.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, length, q) for (s, length), q in seen.items()), key=lambda r: (r[0], r[2]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=40), st.integers(1, 9), st.integers(0, 60), st.lists(st.integers(0, 2), max_size=20))
def test_runs_equal_brute_force(head, period, more, tail):
    w = list(head)
    if len(w) >= period:
        w += [w[len(head) - period + k % period] for k in range(more)]
    w += tail
    assert periodic_runs.find_runs(np.array([*w, 9], np.int64)) == brute_runs(w)


@settings(max_examples=100, deadline=None)
@given(st.permutations(range(40)), st.data())
def test_wavelet_tree_counts_and_selects(values, data):
    tree = periodic_runs.WaveletTree(np.array(values))
    a = data.draw(st.integers(0, 39))
    b = data.draw(st.integers(a + 1, 40))
    x, k = data.draw(st.integers(0, 40)), data.draw(st.integers(0, b - a - 1))
    one = lambda v: np.array([v])
    assert tree.smaller(one(a), one(b), one(x))[0] == sum(v < x for v in values[a:b])
    assert tree.select(one(a), one(b), one(k))[0] == sorted(values[a:b])[k]


def changed(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        n, g = len(w), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def by_hand_runs(doc_id, w):
    runs = brute_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return doc_id, len(w), tuple(runs), " ".join(x for i, x in enumerate(w) if i not in gone)


def test_periodic_runs_odd_rows(messy, empty, monkeypatch):
    want = Counter(by_hand_runs(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in ROWS)
    for at_once in (1 << 17, 3):
        monkeypatch.setattr(periodic_runs, "_AT_ONCE", at_once)
        got = periodic_runs.periodic_runs(messy).collect()
        assert Counter((r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in got) == want
    assert periodic_runs.periodic_runs(empty).collect() == []
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(messy, repeats=2)


def test_long_runs_are_found_in_little_memory():
    w = np.concatenate([np.zeros(200_000, np.int64), np.tile(np.arange(1, 30_001), 5), [50_000]])
    assert periodic_runs.find_runs(w) == [(0, 200_000, 1), (200_000, 150_000, 30_000)]


def test_op13_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: r for r in queries.QUERIES["op13_periodic_runs"](spark, SF).collect()}
    with_runs = 0
    for d in docs:
        _, _, runs, kept = by_hand_runs(d.doc_id, changed(d.doc_id, d.text))
        r = got[d.doc_id]
        assert r.n_runs == len(runs) and r.collapsed_sha256 == hashlib.sha256(kept.encode()).hexdigest()
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None,) * 3)
        assert (r.start, r.length, r.period) == best
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        with_runs += bool(runs)
    assert with_runs >= 5
