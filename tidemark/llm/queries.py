"""One registered query per operator, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer's file (installed beside Python on every worker)."""
    import public_tokenizers
    return public_tokenizers.path(name)


@query
def op2_bloom_language_model(spark, sf_dir):
    from .lm_score import score_table
    return score_table(read_table(spark, sf_dir, "documents")) \
        .select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op5_directly_addressable_ids(spark, sf_dir):
    from .dac_ids import token_file_round_trip
    ids = token_file_round_trip(read_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=0)
    return ids.select("doc_id", "start", F.expr("length(ids) div 4").alias("n_tokens"),
                      F.crc32("ids").alias("ids_crc32"))


@query
def op6_pack_power_of_two(spark, sf_dir):
    from .pack_pow2 import pack_power_of_two
    pieces = pack_power_of_two(read_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"),
                               seq_len=4096, end_id=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


@query
def op9_piece_round_trip(spark, sf_dir):
    from .piece_bpe import piece_round_trip
    rows = piece_round_trip(read_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))
    return rows.select("doc_id", F.expr("length(ids) div 4").alias("n_tokens"),
                       F.sha2(F.col("ids"), 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), "differs")


@query
def op1_language_profiles(spark, sf_dir):
    from .lang_id import language_table
    return language_table(read_table(spark, sf_dir, "documents")) \
        .select("doc_id", "held_out", "lang_pred", "score", "margin")


@query
def op10_license_sentence_rules(spark, sf_dir):
    from .license_rules import scan_licenses
    found = scan_licenses(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_sentences", "n_known", F.size("matches").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct("matches.license")), ",").alias("licenses"),
        F.expr("array_join(transform(matches, m -> concat_ws(':', m.license, cast(m.start as string), "
               "cast(m.end as string))), ',')").alias("spans"))


@query
def op4_small_world_neighbours(spark, sf_dir):
    from .hnsw import nearest_neighbours
    return nearest_neighbours(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query
def op7_maxscore_top10(spark, sf_dir):
    from .maxscore import top_inner_products
    return top_inner_products(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


SQL["op7_maxscore_top10"] = """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
        FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
        SELECT q.vec_id AS query_id, c.vec_id,
               CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id <> c.vec_id
        WHERE q.vec_id % 100 = 0),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


@query
def op8_toccurrence_join(spark, sf_dir):
    from .toccur_join import similarity_groups
    return similarity_groups(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


SQL["op8_toccurrence_join"] = r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x20\x09-\x0D]+') AS words
        FROM documents),
    s AS (
        SELECT doc_id, list_distinct(CASE WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
                   ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) END) AS items
        FROM w WHERE len(words) > 0),
    n AS (SELECT doc_id, len(items) AS n FROM s),
    e AS (SELECT doc_id, unnest(items) AS item FROM s),
    o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_
          FROM e a JOIN e b ON a.item = b.item AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    l AS (SELECT o.a, o.b FROM o JOIN n x ON x.doc_id = o.a JOIN n y ON y.doc_id = o.b
          WHERE 100 * o.both_ >= 85 * (x.n + y.n - o.both_)),
    r(doc_id, root) AS (
        SELECT doc_id, doc_id FROM documents
        UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id WHERE r.root < l.b)
    SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(r.root) AS component_id
    FROM documents d JOIN r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
    GROUP BY d.doc_id, n.n
"""


@query
def op3_skip_chain_personal_data(spark, sf_dir):
    from .pii_crf import KINDS, find_personal_data, learn_field
    docs = read_table(spark, sf_dir, "documents")
    found = find_personal_data(docs, learn_field(docs))
    listed = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"

    def joined(spans: str):
        """kind:start:end by start, then kind as listed."""
        keyed = f"transform({spans}, s -> struct(s.start as a, array_position({listed}, s.kind) as k, s.end as b, s.kind as kind))"
        return F.expr(f"array_join(transform(array_sort({keyed}), s -> concat_ws(':', s.kind, cast(s.a as string), cast(s.b as string))), ',')")

    many = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *many, F.sha2(joined("base"), 256).alias("base_sha256"),
                        joined("concat(base, added)").alias("spans"), F.size("added").cast("long").alias("n_added"))


@query
def op11_suffix_array_repeats(spark, sf_dir):
    from .repeats import remove_repeats
    found = remove_repeats(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), "n_spans",
                        F.sha2(F.col("kept"), 256).alias("kept_sha256"))


@query
def op12_fill_in_middle(spark, sf_dir):
    from .fill_middle import fill_in_middle, restored
    rows = fill_in_middle(read_table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
                       digest(restored(F.col("form"), F.col("output"))).alias("restored_sha256"))


SQL["op12_fill_in_middle"] = """
    WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id) AS d FROM documents),
    h AS (SELECT doc_id, text, length(text) AS n,
                 CAST('0x' || substr(d, 1, 8) AS BIGINT) % (length(text) + 1) AS a,
                 CAST('0x' || substr(d, 9, 8) AS BIGINT) % (length(text) + 1) AS b,
                 CAST('0x' || substr(d, 17, 8) AS BIGINT) % 100 AS c,
                 CAST('0x' || substr(d, 25, 8) AS BIGINT) % 100 AS e
          FROM t),
    f AS (SELECT doc_id, text, n, least(a, b) AS a, greatest(a, b) AS b,
                 CASE WHEN n = 0 OR c >= 90 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain'
                      WHEN e < 20 THEN 'spm' ELSE 'psm' END AS form
          FROM h)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
           CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
           sha256(CASE form
               WHEN 'psm' THEN '<P>' || substr(text, 1, a) || '<S>' || substr(text, b + 1) || '<M>' || substr(text, a + 1, b - a)
               WHEN 'spm' THEN '<S>' || substr(text, b + 1) || '<P>' || substr(text, 1, a) || '<M>' || substr(text, a + 1, b - a)
               ELSE text END) AS output_sha256,
           sha256(text) AS restored_sha256
    FROM f
"""


@query
def op13_periodic_runs(spark, sf_dir):
    from .periodic_runs import periodic_runs
    rows = periodic_runs(read_table(spark, sf_dir, "documents"), plant=True)
    # the greatest exact length / period first, compared crosswise; then the smallest start and period
    best = F.expr("""get(array_sort(runs, (a, b) -> case
        when a.length * b.period <> b.length * a.period then if(a.length * b.period > b.length * a.period, -1, 1)
        when a.start <> b.start then if(a.start < b.start, -1, 1)
        else cast(a.period - b.period as int) end), 0)""")
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("r"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", "r.start", "r.length", "r.period", F.expr("1000 * r.length div r.period").alias("exponent_milli"),
        "runs_sha256", "collapsed_sha256")


SQL["op13_periodic_runs"] = r"""
    WITH d AS (
        SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS o,
               -- crc32: each character of the id, then eight shifts
               xor(list_reduce(list_concat([4294967295], flatten(list_transform(
                       string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1]))),
                   lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END),
                   4294967295) AS h
        FROM documents),
    g AS (SELECT doc_id, o, len(o) AS n, h % 10 = 0 AND len(o) > 0 AS changed, (h // 10) % greatest(len(o), 1) AS a, (h // 10) % 8 AS e
          FROM d),
    p AS (SELECT *, 1 + (n - a) // (3 + e) AS p FROM g),
    w AS (SELECT doc_id, n, CASE WHEN changed
                 THEN list_transform(range(0, n), lambda i: o[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END])
                 ELSE o END AS words
          FROM p),
    u AS (SELECT doc_id, n, unnest(words) AS word, unnest(range(0, n)) AS i FROM w),
    eq AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM u x JOIN u y
           ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
    s AS (SELECT doc_id, q, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k, i FROM eq),
    t AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM s GROUP BY doc_id, q, k
          HAVING count(*) + q >= greatest(6, 4 * q)),
    runs AS (SELECT doc_id, start, length, min(q) AS period FROM t GROUP BY doc_id, start, length),
    best AS (SELECT doc_id, count(*) AS n_runs, first(start ORDER BY length / period DESC, start, period) AS start,
                    first(length ORDER BY length / period DESC, start, period) AS length,
                    first(period ORDER BY length / period DESC, start, period) AS period,
                    string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed
             FROM runs GROUP BY doc_id),
    gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
    c AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.i) AS kept FROM u ANTI JOIN gone ON u.doc_id = gone.doc_id AND u.i = gone.i
          GROUP BY u.doc_id)
    SELECT w.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
           sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
    FROM w LEFT JOIN best ON best.doc_id = w.doc_id LEFT JOIN c ON c.doc_id = w.doc_id
"""
