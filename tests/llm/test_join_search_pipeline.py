"""The similarity join, both vector searches and the pipeline against brute force."""

import collections
import os
import random
import re
import shutil
import subprocess
import sys

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from tidemark.llm import graph, hnsw, maxscore, toccur_join as J, vectors as V  # noqa: E402

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"


# -- T-occurrence search ---------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sets(st.integers(0, 30), max_size=20), min_size=1, max_size=25), st.integers(1, 8))
def test_divide_skip_equals_counting(sets, need):
    n = collections.Counter(x for s in sets for x in s)
    lists = [np.array(sorted(s), np.int64) for s in sets]
    assert J.divide_skip(lists, need) == {x: k for x, k in n.items() if k >= need}
    got = J.merge_skip([sorted(s) for s in sets if s], need)
    assert got == {x: k for x, k in n.items() if k >= need}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sets(st.integers(0, 40), min_size=1, max_size=30), min_size=2, max_size=12), st.sampled_from([50, 80, 85, 100]))
def test_search_equals_jaccard(sets, percent):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    want = [k for k, s in enumerate(sets[1:]) if 100 * len(sets[0] & s) >= percent * len(sets[0] | s)]
    assert sorted(J.search(arrays[0], arrays[1:], percent)) == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(0, 60), min_size=1, max_size=50), st.integers(0, 2), st.booleans(), st.booleans()),
                min_size=1, max_size=12), st.sampled_from([30, 80, 85, 100]), st.booleans())
def test_prints_keep_all_that_link(rows, percent, wide):
    sets = [np.sort(J.mix(np.array(sorted(s), np.uint64))) if wide else np.array(sorted(s), np.uint64) for s, *_ in rows]
    held = [(comp, query, member, len(s), J.parity_of(s)) for (_, comp, query, member), s in zip(rows, sets)]
    may = J.may_link(held, percent)
    for (a, comp, query, _), m in zip(rows, may):
        for k, (b, other, _, member) in enumerate(rows):
            if query and member and comp != other and 100 * len(a & b) >= percent * len(a | b):
                assert m and may[k]
    assert not any(m for m, (_, _, query, member) in zip(may, rows) if not query and not member)


def test_prints_leave_out_pairs_that_share_a_part():
    """Texts with 60 of 100 shingles in common meet in lists, but their sets needn't be made."""
    items = J.mix(np.arange(1400, dtype=np.uint64))
    a, b, c = (np.sort(items[k:k + 800]) for k in (0, 200, 30))
    row = lambda s, query: (s[0].item() % 1000, query, not query, len(s), J.parity_of(s))
    assert J.may_link([row(a, True), row(b, False), row(c, False)], 85).tolist() == [True, False, True]
    assert J.may_link([row(a, True), row(b, False)], 85).tolist() == [False, False]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_groups(rows, width, percent):
    """(doc_id, set size, smallest id of the component) of every row."""
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return collections.Counter((doc, len(sets[i]), least.get(find(i))) for i, (doc, _) in enumerate(rows))


def near_copies(seed):
    """Groups of copies with chains of edits, a passage that many share, and odd rows."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    rows, doc = [], 0
    for size in (60, 25, 6, 2, 1, 1, 1):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(30, 120))]
        for _ in range(size):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            if rng.random() < 0.2:
                text += passage
            rows.append((doc, rng.choice([" ", "  ", "\n"]).join(text).replace("w1", rng.choice(["w1", "W1"]))))
            doc += 1
    for _ in range(30):
        rows.append((doc, " ".join(passage + [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))])))
        doc += 1
    rows += [(doc, None), (doc + 1, ""), (doc + 2, " \n "), (doc + 3, "one two"), (doc + 4, "One  two"), (doc + 5, "one two three"),
             rows[3], (None, rows[3][1]), (None, "nobody else says this at all today"), (None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, settings_", [(1, {}), (2, {"block": 3, "short_list": 1}), (3, {"block": 4, "short_list": 5, "shared": 2})])
def test_groups_equal_brute_force(spark, seed, settings_):
    rows = near_copies(seed)
    docs = spark.createDataFrame([(d, t, "T", 1, 2) for d, t in rows], "doc_id long, text string, TEXT string, n long, node long")
    got = J.similarity_groups(docs, **settings_).collect()
    want = brute_groups(rows, 4, 85)
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want


def test_rare_shingles_come_first_where_every_class_is_full():
    """Of texts so many that each class of shingles holds 800, words still tell rare shingles from frequent ones."""
    hashes, size = J.WordHashes(), 1 << J.SKETCH_BITS
    text = "the of and to the of and in gluon braid the of"
    words = hashes.of(text)[:-1]
    n_words, n_shingles = np.full(size, 100), np.full(size, 800) + np.arange(size) % 29
    n_words[J.class_of(hashes.of("the of and to in")[:-1])] = 10_000_000
    every = J.all_shingles(words, 4)
    hot = J.class_of(every[6:7])                    # "and in gluon braid": a passage that many repeat
    order = J.Order(J._codes(n_shingles), J._codes(n_words))
    items, rank = order.rank(words, 4)
    assert items.tolist() == np.unique(every).tolist()
    by = dict(zip(items.tolist(), rank.tolist()))
    plain, rare = [by[k] for k in every[:5].tolist()], [by[k] for k in every[5:].tolist()]
    assert max(rare) < min(plain)
    n_shingles[hot] = 500_000
    items, rank = J.Order(J._codes(n_shingles), J._codes(n_words)).rank(words, 4)
    by = dict(zip(items.tolist(), rank.tolist()))
    assert by[every[6].item()] > max(by[k] for k in every[5:].tolist() if k != every[6])


def test_groups_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert J.similarity_groups(docs).collect() == []


def test_one_of_each_group_stays(spark):
    rows = near_copies(4)
    docs = spark.createDataFrame([(t, d, "T") for d, t in rows], "text string, doc_id long, TEXT string")
    kept = J.keep_one_of_each_group(docs, width=5, percent=80)
    assert kept.columns == docs.columns
    want = {(d, t) for d, t in rows for k in brute_groups(rows, 5, 80) if d is not None and k[0] == d and k[2] == d}
    assert collections.Counter((r[1], r[0]) for r in kept.collect() if r[1] is not None) == collections.Counter(want)
    assert sum(r[1] is None for r in kept.collect()) == 3


LONG = [" ".join(f"w{k}x{i}" for i in range(60)) for k in range(3)]
A = LONG[0]
NEAR_A = A.replace("w0x59", "new")          # links with A and with the next one
BRIDGE = NEAR_A.replace("w0x0 ", "old ")


def test_rows_without_an_id_link_others(spark):
    """A and C link only through a text that no row with an id holds."""
    words = [f"v{i}" for i in range(80)]
    a, n, c = (" ".join(words[k:k + 70]) for k in (0, 3, 6))
    for rows in ([(1, a), (None, n), (2, c)], [(1, a), (5, n), (2, c)]):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = {r.doc_id: r.component_id for r in J.similarity_groups(docs).collect()}
        assert set(got.values()) == {1}
    alone = spark.createDataFrame([(1, a), (2, c)], "doc_id long, text string")
    assert {r.component_id for r in J.similarity_groups(alone).collect()} == {1, 2}


def test_an_id_of_several_texts_loses_its_copies_only(spark):
    rows = [(1, A), (2, NEAR_A), (2, LONG[1]), (3, LONG[2]), (3, LONG[2]), (4, None), (4, ""), (5, LONG[1]), (6, BRIDGE), (None, A),
            (7, "short text"), (7, "another one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(r) for r in J.keep_one_of_each_group(docs, width=5, percent=80).collect()]
    want = [(1, A), (2, LONG[1]), (3, LONG[2]), (4, None), (4, ""), (None, A), (7, "short text"), (7, "another one")]
    assert sorted(kept, key=str) == sorted(want, key=str)
    several = spark.createDataFrame([(1, A), (1, NEAR_A), (1, LONG[1])], "doc_id long, text string")
    assert {r.text for r in J.keep_one_of_each_group(several, width=5, percent=80).collect()} in ({A, LONG[1]}, {NEAR_A, LONG[1]})


@pytest.mark.parametrize("links", [[], [(i, i + 1) for i in range(40)], [(7, i) for i in range(40)],
                                   [(3, 9), (9, 4), (20, 21), (21, 21), (5, 6), (6, 5)]])
def test_components(spark, links):
    want = {}
    for a, b in [x for x in links * 45 if x[0] != x[1]]:
        low = min(want.get(a, a), want.get(b, b))
        want[a] = want[b] = low
    got = graph.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.comp for r in got} == want and len(got) == len(want)


# -- vectors ---------------------------------------------------------------------


def vector_rows(dim=8, n=300, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=dim) * rng.choice([0.3, 1.0])]) for i in range(n)]
    same = rows[17][1]
    rows += [(n + i, same) for i in range(80)]                  # a large group of copies: ties by id
    rows += [(n + 100, [0.0] * dim), (n + 101, None), (n + 102, [None] + [1.0] * (dim - 1)), (n + 103, [float("nan")] * dim),
             (n + 104, [float("inf")] + [0.0] * (dim - 1)), (n + 105, []), (n + 106, [1.0, 2.0]), (n + 120, [2.0, -1.0]),
             (None, same), rows[5], rows[5]]
    return rows


def brute_nearest(rows, every, k, number, allow_zero):
    own = []
    for i, v in {(i, tuple(v) if v is not None else None): (i, v) for i, v in rows}.values():
        ok = i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
        if ok and (allow_zero or any(v)):
            own.append((i, np.array([number(x) for x in v])))
    out = {}
    for q, v in own:
        if q % every == 0:
            near = sorted((-(v @ u).item() if len(v) else 0, i) for i, u in own if i != q and len(u) == len(v))[:k]
            out[q] = [(i, -s) for s, i in near]
    return out


def answers(rows):
    out = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out[r.query_id].append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_maxscore_equals_brute_force(spark):
    rows = vector_rows()
    table = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id long, embedding array<float>, shard int, score double")
    got = answers(maxscore.top_inner_products(table, F.col("vec_id") % 10 == 0, k=10, shard_rows=60, block_rows=7).collect())
    want = brute_nearest(rows, 10, 10, lambda x: int(np.floor(1024 * x)), True)
    assert got == {q: a for q, a in want.items() if a}
    assert maxscore.top_inner_products(table.limit(0), F.col("vec_id") % 10 == 0).collect() == []


def test_small_world_search(spark):
    rows = vector_rows(seed=3)
    table = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id long, embedding array<float>, shard int, score double")
    got = answers(hnsw.nearest_neighbours(table, F.col("vec_id") % 10 == 0, k=20, shard_rows=120, block_rows=16).collect())
    want = brute_nearest(rows, 10, 20, float, False)
    assert set(got) == {q for q, a in want.items() if a}
    hits = total = 0
    for q, a in got.items():
        near = dict(want[q])
        assert len(a) == len(near) and [x[1] for x in a] == sorted((x[1] for x in a), reverse=True)
        hits, total = hits + sum(i in near for i, _ in a), total + len(near)
        assert all(abs(near[i] - s) < 1e-9 for i, s in a if i in near)
    assert hits / total >= 0.95
    assert hnsw.nearest_neighbours(table.limit(0), F.col("vec_id") % 10 == 0).collect() == []


def test_recall_on_a_whole_shard():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 32)) * rng.uniform(0.5, 2, (1500, 1))
    g = hnsw.Graph(hnsw.equal_lengths(x)).build()
    q = rng.normal(size=(100, 32))
    node, _ = g.search(np.concatenate([q, np.zeros((100, 1))], 1), hnsw.EF_SEARCH)
    want = np.argsort(-(q @ x.T), 1)[:, :20]
    assert np.mean([len(set(a[:20]) & set(b)) / 20 for a, b in zip(node, want)]) >= 0.9
    assert all((near[near >= 0] < len(x)).all() for near in g.near)
    # a graph read back from its flat arrays answers alike
    h = hnsw.load_graph(x, [np.flatnonzero(r >= 0).astype("<i4").tobytes() for r in g.rows], [m.astype("<i4").tobytes() for m in g.near])
    assert (h.search(np.concatenate([q, np.zeros((100, 1))], 1), 50)[0] == g.search(np.concatenate([q, np.zeros((100, 1))], 1), 50)[0]).all()


@pytest.mark.parametrize("scale", [50, 1 << 24, 1 << 30])
def test_postings_with_any_threshold(scale):
    """The largest scale is beyond what doubles hold exactly."""
    rng = np.random.default_rng(2)
    for n in (1, 5, 200, 900):
        x = rng.integers(-scale, scale, (n, 6)) * rng.integers(0, 2, (n, 6))
        blocks = maxscore.like_blocks(x.astype(float), 16)
        order = np.concatenate(blocks)
        assert sorted(order.tolist()) == list(range(n)) and max(map(len, blocks)) <= 16
        p = maxscore.Postings(np.ascontiguousarray(x[order].T).astype(float), np.cumsum([len(b) for b in blocks]), order)
        q = rng.integers(-scale, scale, (20, 6)) * rng.integers(0, 2, (20, 6))
        score = q.astype(object) @ x.T.astype(object)
        want = [sorted(range(n), key=lambda r: (-s[r], r))[:10] for s in score]
        for low in (-np.inf, None):
            least = np.array([float(s[w[-1]]) * (1 - 1e-12) if low is None and s[w[-1]] > 0 else -np.inf for s, w in zip(score, want)])
            for (rows, got), s, w in zip(p.top(q.astype(float), 10, least), score, want):
                found = sorted(zip((-got).tolist(), order[rows].tolist()))
                assert [i for _, i in found][:10] == w and [-v for v, _ in found][:10] == [s[i] for i in w]


def test_scores_beyond_doubles_are_exact_or_raise(spark):
    table = spark.createDataFrame([(0, [3e9, 1.0]), (1, [100.0, 5.0]), (2, [101.0, 2.0 ** -10])], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.score for r in maxscore.top_inner_products(table, F.col("vec_id") == 0, k=2).collect()}
    assert got == {i: int(3e9 * 1024) * int(1024 * x) + 1024 * int(1024 * y) for i, x, y in ((1, 100.0, 5.0), (2, 101.0, 2.0 ** -10))}
    huge = spark.createDataFrame([(0, [3e15]), (1, [3e15])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="doesn't fit into a long"):
        maxscore.top_inner_products(huge, F.col("vec_id") == 0, k=2).collect()


def test_thresholds_go_to_all_shards(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=8).round(3).tolist()) for i in range(400)] + [(1000 + i, [1.0] * 8) for i in range(30)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = answers(maxscore.top_inner_products(table, F.col("vec_id") % 20 == 0, k=10, shard_rows=50, block_rows=5, like_rows=8).collect())
    assert got == brute_nearest(rows, 20, 10, lambda x: int(np.floor(1024 * x)), True)


def test_copies_keep_their_smallest_ids(spark):
    rows = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(100)] + [(500, [0.0, 1.0])], "vec_id long, vec array<double>")
    got = {tuple(r.vec): list(r.ids) for r in V.distinct_vectors(rows, 5).collect()}
    assert got == {(1.0, 0.0): [0, 1, 2, 3, 4, 5], (0.0, 1.0): [500]}


# -- pipeline ----------------------------------------------------------------------


def test_pipeline_equals_stages_by_hand(spark, tmp_path):
    """Near copies, junk, an odd row of every kind: each stage's effect is worked out in plain Python."""
    import corpus_pipeline
    from tidemark.llm import lang_id, pii_crf, token_cache
    from tidemark.llm.queries import tokenizer_file
    base = spark.read.parquet(f"{SF}/documents.parquet")
    extra = [(1000, None, "en", "x", None), (1001, "", None, "x", 0), (1002, "123 456 !!!", "en", "x", 11), (1003, "日本語", None, "x", 3)]
    first = [tuple(r) for r in base.collect()]
    extra += [(1004, first[0][1] + " tail", "fr", "x", len(first[0][1]) + 5), first[7]]
    docs = base.union(spark.createDataFrame(extra, base.schema))
    folder = str(tmp_path / "sf")
    docs.coalesce(2).write.parquet(f"{folder}/documents.parquet")
    got = corpus_pipeline.run(spark, folder).collect()

    rows = first + extra
    profiles = lang_id.learn_profiles(docs)
    cuts = lang_id.learn_cuts(docs, profiles)
    ranker = lang_id.Ranker(profiles, lang_id.PROFILE_SIZE)
    kept = [r for r in rows if (lambda a: a[0] != "und" and a[1] >= lang_id.cut_of(cuts, a[0], a[3]))(ranker.measure(r[1]))]
    assert not {1000, 1001, 1002, 1003} & {r[0] for r in kept} and len(kept) == len(rows) - 4
    least = brute_groups([(r[0], r[1]) for r in kept], 5, 80)
    roots = {d for d, _, c in least if d == c}
    kept = list({(r[0], r[1]) for r in kept if r[0] in roots})
    assert 1004 not in {d for d, _ in kept}
    field = pii_crf.learn_field(spark.createDataFrame(kept, "doc_id long, text string"))
    tok = token_cache.encoder(tokenizer_file("word_bpe_49k.json")).tok
    want = collections.Counter()
    for d, t in kept:
        want[d, tuple(tok.encode(pii_crf.mask(t, field), add_special_tokens=False).ids + [2])] += 1
    parts = collections.defaultdict(list)
    for r in got:
        parts[r.doc_id].append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    assert collections.Counter((d, tuple(i for _, p in sorted(x) for i in p)) for d, x in parts.items()) == want


FOREIGN = [
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem "
    "i powinni postępować wobec innych w duchu braterstwa.",
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, "
    "ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı "
    "kardeşlik zihniyeti ile hareket etmelidirler.",
    "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e "
    "devono agire gli uni verso gli altri in spirito di fratellanza.",
]


def test_pipeline_drops_foreign_texts_in_latin_script(spark):
    """Texts in no learned language go, though their letters are those of the learned ones; short known texts stay."""
    import corpus_pipeline
    base = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    short = base.where("lang = 'en'").orderBy("doc_id").limit(3).collect()
    extra = [(10**6 + i, t, None, "x", len(t)) for i, t in enumerate(FOREIGN)]
    extra += [(2 * 10**6 + i, r.text[:40], None, "x", 40) for i, r in enumerate(short)]
    docs = base.union(spark.createDataFrame(extra, base.schema))
    ids = {r.doc_id for r in corpus_pipeline.STAGES[0][1](spark, docs, SF).select("doc_id").collect()}
    assert not {10**6 + i for i in range(len(FOREIGN))} & ids
    assert {2 * 10**6 + i for i in range(len(short))} <= ids
    assert len(ids) >= 0.999 * base.count()


def test_stages_keep_the_columns(spark):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in docs.schema]
        assert stage(spark, docs.limit(0), SF).collect() == []


def test_library_works_without_this_folder(tmp_path):
    for name in ("tidemark", "__spark_entry__.py"):
        src = os.path.join(REPO, name)
        if os.path.isdir(src):
            shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(src, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); s = e.oracle_sql(); assert q and not any(x.startswith('op') and x[2].isdigit() or x == 'pipeline' for x in [*q, *s] if len(x) > 2)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
