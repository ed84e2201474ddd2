"""Source and sink queries: files written from the driver tables, read back by the
library's readers, and compared with the table they came from.

Files go to a fresh folder under the shared checkpoint folder (``scratch_path``).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clean as CL
from ..functions import dates as DT
from ..functions import text as TX
from ..operators import align as AL
from ..session import scratch_path
from ..sources import bars, delimited, html, sinks, surveys
from . import sqlkit as Q
from . import tables as TB
from .catalog import query

# Largest number of data rows one written fixture file may hold; keys with more rows
# are split into several files (each repeating the preamble) so no task writes a hot key alone.
FILE_ROWS = 50_000

_WEEKLY_RESELL = ("SELECT year, month, week, name, price, category, "
                  "CASE WHEN l_linenumber > 4 THEN 'True' ELSE 'False' END AS is_resell FROM w")


def _weekly_with_resell(spark, sf_dir):
    w = TB.weekly_items(spark, sf_dir)
    return w.withColumn("is_resell", F.when(F.col("l_linenumber") > 4, "True").otherwise("False"))


@query("k1s1s4_csv_roundtrip", Q.cte(w=Q.WEEKLY_ITEMS) + _WEEKLY_RESELL)
def k1s1s4_csv_roundtrip(spark, sf_dir):
    """The merged items written as header CSV (K1), read back as strings (S1), renamed by
    position (S4) and cast leniently (P1)."""
    src = _weekly_with_resell(spark, sf_dir).drop("l_orderkey", "l_linenumber")
    path = sinks.write_csv(src, scratch_path(spark, "weekly-csv"))
    df = delimited.read_csv_strings(spark, path, names=["year", "month", "week", "name", "price",
                                                        "category", "is_resell"])
    return df.withColumns({c: CL.to_number(c).cast("int") for c in ("year", "month", "week")})


@query("k2s2s5_weekly_files", Q.cte(w=Q.WEEKLY_ITEMS) + _WEEKLY_RESELL)
def k2s2s5_weekly_files(spark, sf_dir):
    """The scraper's per-(month, week) files: two preamble lines (月,週 / values) and a
    header, then the items (K2); read back by file-name keys (S5) skipping the
    preamble (S2), weeks 1–4 and years 14–25 only, as the merge reads them."""
    w = _weekly_with_resell(spark, sf_dir)
    name = F.format_string("20%02d%02d_%d.csv", F.col("year"), F.col("month"), F.col("week"))
    keys = w.select(name.alias("name"), "month", "week").distinct()
    pre = keys.select("name", F.posexplode(F.array(
        F.lit("月,週"), F.concat_ws(",", F.col("month").cast("string"), F.col("week").cast("string")),
        F.lit("名前,価格,カテゴリー,再販"))).alias("pos", "line"))
    rows = w.select(name.alias("name"),
                    (F.lit(10) + F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"),
                    F.to_csv(F.struct("name", "price", "category", "is_resell")).alias("line"))
    path = sinks.write_with_preamble(pre.unionByName(rows), scratch_path(spark, "weekly-files"),
                                     "name", "pos", preamble_until=3, max_rows_per_file=FILE_ROWS)
    df = delimited.read_keyed_files(
        spark, path, r"^20(\d{2})(\d{2})_(\d)\.csv$", ["year", "month", "week"], skip=2,
        names=["name", "price", "category", "is_resell"],
        key_filter=F.col("week").between(1, 4) & F.col("year").between(14, 25), name_col="name")
    return df.drop("file", "line_no")


def _fx_lines(spark, sf_dir):
    o = TB.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice",
                                                 "o_orderpriority")
    o = o.where(F.col("o_orderpriority").isin(*TB.RATE_SERIES.values()))
    pair = F.create_map(*[x for n, p in TB.RATE_SERIES.items() for x in (F.lit(p), F.lit(n))])
    day = (o.groupBy(pair[F.col("o_orderpriority")].alias("pair"), F.to_date("o_orderdate").alias("d"))
           .agg((F.avg(TB.cents("o_totalprice")) / 100.0).alias("close"),
                F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"),
                F.min_by("o_totalprice", "o_orderkey").alias("open"), F.count(F.lit(1)).alias("volume")))
    name = F.concat(F.col("pair"), F.lit("=X.csv"))
    rows = day.select(name.alias("name"), (F.unix_date("d") + 10).cast("long").alias("pos"),
                      F.concat_ws(",", F.col("d").cast("string"), *[F.col(c).cast("string") for c in
                                                                     ("close", "high", "low", "open", "volume")])
                      .alias("line"))
    pre = day.select(name.alias("name")).distinct().select("name", F.posexplode(F.array(
        F.lit("Price,Close,High,Low,Open,Volume"),
        F.concat(F.lit("Ticker"), F.lit(",X,X,X,X,X")), F.lit("Date,,,,,"))).alias("pos", "line"))
    return pre.select("name", F.col("pos").cast("long"), "line").unionByName(rows)


@query("s2s4p4_fx_files_full_outer", Q.RATES)
def s2s4p4_fx_files_full_outer(spark, sf_dir):
    """Three daily-bar files with a 3-line preamble (S2), renamed by
    position (S4), dates parsed strictly (P4), closes leniently (P1), one series per
    file (P12), full outer joined on Date (J1)."""
    path = sinks.write_with_preamble(_fx_lines(spark, sf_dir), scratch_path(spark, "fx"), "name", "pos",
                                     preamble_until=3, max_rows_per_file=FILE_ROWS)
    df = delimited.read_with_preamble(spark, path, skip=3, header=False,
                                      names=["Date", "Close", "High", "Low", "Open", "Volume"],
                                      name_col="name")
    df = df.withColumns({"Date": CL.to_date_strict("Date"), "Close": CL.to_number("Close")})
    series = [CL.project_rename(df.where(F.col("file") == f"{n}=X.csv"), {"Close": n}, keep=["Date"])
              for n in TB.RATE_SERIES]
    return AL.full_outer_on(series, "Date", unique_keys=True)


def _layout_by_year():
    return F.when(F.col("year") <= 1996, "gs").when(F.col("year") <= 1998, "gsb").otherwise("b")


def _survey_lines(spark, sf_dir):
    o = TB.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice",
                                                 "o_orderpriority")
    o = o.where(F.col("o_orderpriority") == TB.SIDE_PRIORITY).select(
        "o_orderkey", F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"),
        TB.cents("o_totalprice").alias("price"))
    o = o.withColumn("layout", _layout_by_year())
    name = F.format_string("%s_%04d%02d.csv", F.when(F.col("layout") == "b", "b101")
                           .when(F.col("layout") == "gsb", "gsb2021").otherwise("gs2016"),
                           F.col("year"), F.col("month"))
    o = o.withColumn("name", name)
    lay = {l.name: l for l in surveys.LAYOUTS}
    heisei = F.format_string("平成%d年%d月", F.col("year") - 1988, F.col("month"))
    kanji = F.format_string("%d年%d月", F.col("year"), F.col("month"))
    fixed = F.format_string("%04d年 %02d月", F.col("year"), F.col("month"))

    def row_with(cell_idx, text, width=16):
        cells = [F.lit("")] * width
        cells[cell_idx] = text
        return F.concat_ws(",", *cells)

    keys = o.select("name", "layout", "year", "month").distinct()
    pre_lines = []
    for ln in lay.values():
        date_text = {"kanji": kanji, "fixed": fixed, "heisei": heisei}[ln.date_form]
        arr = []
        for pos in range(ln.skip + 1):
            if pos == ln.date_row:
                arr.append(row_with(ln.date_col, date_text))
            elif pos == ln.skip:
                arr.append(F.lit(",".join(f"h{i}" for i in range(16))))
            else:
                arr.append(F.lit(f"調査票 {pos}"))
        pre_lines.append(keys.where(F.col("layout") == ln.name)
                         .select("name", F.posexplode(F.array(*arr)).alias("pos", "line")))
    pre = pre_lines[0]
    for p in pre_lines[1:]:
        pre = pre.unionByName(p)
    price_line = None
    for ln in lay.values():
        expr = row_with(ln.price_col, F.col("price").cast("string"))
        price_line = (F.when(F.col("layout") == ln.name, expr) if price_line is None
                      else price_line.when(F.col("layout") == ln.name, expr))
    rows = o.select("name", (F.lit(100) + F.col("o_orderkey")).alias("pos"), price_line.alias("line"))
    return pre.select("name", F.col("pos").cast("long"), "line").unionByName(rows)


_SURVEY_SQL = (f"SELECT CASE WHEN year(o_orderdate) <= 1996 THEN 'gs' WHEN year(o_orderdate) <= 1998 "
               f"THEN 'gsb' ELSE 'b' END AS layout, CAST(year(o_orderdate) AS INTEGER) AS year, "
               f"CAST(month(o_orderdate) AS INTEGER) AS month, "
               f"avg({Q.cents('o_totalprice')}) AS price_mean, count(*) AS n_prices FROM orders "
               f"WHERE o_orderpriority = '{TB.SIDE_PRIORITY}' GROUP BY 1, 2, 3")


def _survey_path(spark, sf_dir):
    return sinks.write_with_preamble(_survey_lines(spark, sf_dir), scratch_path(spark, "survey"),
                                     "name", "pos", preamble_until=100, max_rows_per_file=FILE_ROWS)


def _survey_rows(spark, sf_dir):
    return surveys.read_survey_folder(spark, _survey_path(spark, sf_dir), name_col="name")


@query("s6s7a6_survey_folder", _SURVEY_SQL)
def s6s7a6_survey_folder(spark, sf_dir):
    """One file per month in three layouts; dispatch by name (S6),
    date cell by (row, col) (S7), mean price per file (A6)."""
    rows, _ = _survey_rows(spark, sf_dir)
    # a month written as several chunk files comes back as several rows; their sums
    # (of whole cents, exact) recombine into the month's mean
    return (rows.groupBy("layout", "year", "month")
            .agg((F.sum("price_sum") / F.sum("n_prices")).alias("price_mean"),
                 F.sum("n_prices").alias("n_prices")))


@query("a18_survey_ingest_tally",
       f"SELECT 'ok' AS status, count(*) AS months FROM ({_SURVEY_SQL})")
def a18_survey_ingest_tally(spark, sf_dir):
    """Success / error tally of the folder job, counted per survey month (a month may
    be written as several chunk files)."""
    files = surveys.survey_files(spark, _survey_path(spark, sf_dir), name_col="name")
    months = files.groupBy("file").agg(F.min("year").alias("year"), F.min("month").alias("month"))
    return surveys.ingest_tally(months).withColumnRenamed("files", "months")


@query("f10f11f12_survey_date_cells",
       Q.cte(s=Q.SIDE_MONTHLY) + "SELECT year, month, year AS y_kanji, month AS m_kanji, "
       "year AS y_fixed, month AS m_fixed, year AS y_heisei, month AS m_heisei FROM s")
def f10f11f12_survey_date_cells(spark, sf_dir):
    """The three written forms of a survey month parse back to the month."""
    s = TB.side_monthly(spark, sf_dir).select("year", "month")
    kanji = F.format_string("%d年%d月", F.col("year"), F.col("month"))
    fixed = F.format_string("%04d年 %02d月", F.col("year"), F.col("month"))
    heisei = F.format_string("平成%d年%d月", F.col("year") - 1988, F.col("month"))
    yk, mk = DT.split_year_month(kanji)
    yf, mf = DT.fixed_year_month(fixed)
    yh, mh = DT.heisei_year_month(heisei)
    return s.select("year", "month", yk.alias("y_kanji"), mk.alias("m_kanji"), yf.alias("y_fixed"),
                    mf.alias("m_fixed"), yh.alias("y_heisei"), mh.alias("m_heisei"))


# ---------------------------------------------------------------------------
# whitespace text

_WS = CL.USPACE


def _ws_sql():
    strip = f"regexp_replace(line, '^{_WS}+|{_WS}+$', '', 'g')"
    lines = (f"SELECT source, {strip} AS s FROM (SELECT source, unnest(regexp_split_to_array(text, "
             f"'\\r\\n|\\r|\\n')) AS line FROM documents)")
    return (f"SELECT source AS file, count(*) AS n_lines, count(DISTINCT len(regexp_split_to_array(s, '{_WS}+'))) "
            f"AS n_widths, CAST(min(len(regexp_split_to_array(s, '{_WS}+'))) AS INTEGER) AS min_fields, "
            f"CAST(max(len(regexp_split_to_array(s, '{_WS}+'))) AS INTEGER) AS max_fields, "
            f"count(DISTINCT len(regexp_split_to_array(s, '{_WS}+'))) > 1 AS inconsistent "
            f"FROM ({lines}) WHERE length(s) > 0 GROUP BY source")


@query("s9a17_whitespace_text", _ws_sql())
def s9a17_whitespace_text(spark, sf_dir):
    """csv_conv.py: whitespace-separated text files (one folder per source), split on
    Unicode whitespace (S9) and checked for consistent field counts (A17)."""
    docs = TB.table(spark, sf_dir, "documents").select("source", "text")
    path = scratch_path(spark, "ws-text")
    docs.write.mode("overwrite").partitionBy("source").text(path)
    t = spark.read.text(path).select(F.col("source").alias("file"), F.col("value").alias("line"))
    t = t.where(F.length(CL.ustrip("line")) > 0).select("file", TX.whitespace_fields("line").alias("fields"))
    return delimited.field_count_check(t)


@query("k3_delimited_rewrite",
       f"SELECT count(*) AS n_lines, CAST(sum(len(regexp_split_to_array(s, '{_WS}+'))) AS BIGINT) AS n_fields FROM ("
       f"SELECT regexp_replace(line, '^{_WS}+|{_WS}+$', '', 'g') AS s FROM (SELECT unnest("
       f"regexp_split_to_array(text, '\\r\\n|\\r|\\n')) AS line FROM documents)) WHERE length(s) > 0")
def k3_delimited_rewrite(spark, sf_dir):
    """The split fields written back with a chosen delimiter (K3) and counted again."""
    docs = TB.table(spark, sf_dir, "documents").select("text")
    lines = docs.select(F.explode(F.split("text", r"\r\n|\r|\n")).alias("line"))
    lines = lines.where(F.length(CL.ustrip("line")) > 0).select(TX.whitespace_fields("line").alias("f"))
    path = sinks.write_delimited_fields(lines, scratch_path(spark, "tsv"), "f", "\t")
    back = spark.read.text(path).select(F.split("value", "\t").alias("f"))
    return back.agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.size("f")).alias("n_fields"))


# ---------------------------------------------------------------------------
# URLs and pages

_URL_CELL_SQL = "'参照先：' || url || ' 。予備 ' || url"


@query("s10_url_list_shift_jis",
       f"SELECT page_id, CAST(u.i - 1 AS INTEGER) AS url_no, u.url FROM (SELECT page_id, "
       f"regexp_extract_all({_URL_CELL_SQL}, '{TX.URL_PATTERN}') AS urls FROM pages), "
       f"unnest(urls) WITH ORDINALITY AS u(url, i)")
def s10_url_list_shift_jis(spark, sf_dir):
    """A URL list: a Shift_JIS CSV whose 2nd column holds notes with URLs."""
    # the list is written once, here and now; the switch for its charset is set back after
    switch = "spark.sql.legacy.javaCharsets"
    before = spark.conf.get(switch, None)
    spark.conf.set(switch, "true")
    p = TB.table(spark, sf_dir, "pages").select("page_id", "url")
    cell = F.concat(F.lit("参照先："), F.col("url"), F.lit(" 。予備 "), F.col("url"))
    path = scratch_path(spark, "urls")
    (p.select(F.col("page_id").cast("string"), cell.alias("note")).write.mode("overwrite")
     .option("encoding", "Shift_JIS").option("header", False).csv(path))
    spark.conf.unset(switch) if before is None else spark.conf.set(switch, before)
    urls = delimited.extract_urls(spark, path, column_index=1, key_index=0)
    return urls.select(F.col("key").cast("long").alias("page_id"), "url_no", "url")


_UNESC = ("replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), "
          "'&#39;', ''''), '&amp;', '&')")

_NAV_SPEC = html.BlockSpec(block=html.Sel("nav"), item=html.Sel("li"),
                           item_fields={"text": html.Sel("a"), "href": html.Sel("a", attr="href")})


@query("s11_page_links",
       "SELECT page_id, 0 AS block_no, CAST(m.i - 1 AS INTEGER) AS item_no, "
       + _UNESC.format(x="regexp_extract(m.li, '<a href=\"([^\"]*)\">', 1)") + " AS href, "
       + _UNESC.format(x="regexp_extract(m.li, '>([^<]*)</a>', 1)") + " AS text "
       "FROM (SELECT page_id, regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1), "
       "'<li>(.*?)</li>', 1) AS lis FROM pages), unnest(lis) WITH ORDINALITY AS m(li, i)")
def s11_page_links(spark, sf_dir):
    """Pages → link rows with the selector-spec extractor (block nav, item li, a text/href)."""
    p = TB.table(spark, sf_dir, "pages")
    return html.extract_blocks(p, "html", ["page_id"], _NAV_SPEC)


_TITLE_SPEC = html.BlockSpec(block=html.Sel("article"), block_fields={"title": (html.Sel("h1"), 0)})


@query("s11_article_titles",
       "SELECT page_id, 0 AS block_no, CAST(NULL AS INTEGER) AS item_no, "
       + _UNESC.format(x="regexp_extract(html, '<article><h1>(.*?)</h1>', 1)") + " AS title FROM pages")
def s11_article_titles(spark, sf_dir):
    p = TB.table(spark, sf_dir, "pages")
    return html.extract_blocks(p, "html", ["page_id"], _TITLE_SPEC)


@query("f14_urls_in_pages",
       f"SELECT page_id, CAST(len(regexp_extract_all(html, '{TX.URL_PATTERN}')) AS INTEGER) AS n_urls, "
       f"coalesce(list_aggregate(regexp_extract_all(html, '{TX.URL_PATTERN}'), 'string_agg', ' '), '') AS urls FROM pages")
def f14_urls_in_pages(spark, sf_dir):
    p = TB.table(spark, sf_dir, "pages").select("page_id", TX.find_urls("html").alias("u"))
    return p.select("page_id", F.size("u").alias("n_urls"), F.array_join("u", " ").alias("urls"))


@query("f15f17_url_parts",
       "SELECT page_id, regexp_extract(url, '[^\\\\/]+$', 0) AS base, "
       "CASE WHEN strpos(url, '=') > 0 THEN split_part(url, '=', 2) END AS after_eq FROM pages")
def f15f17_url_parts(spark, sf_dir):
    p = TB.table(spark, sf_dir, "pages")
    return p.select("page_id", TX.basename("url").alias("base"), TX.after_equals("url").alias("after_eq"))


@query("f16_drop_blank_lines_docs",
       f"SELECT doc_id, CAST(length(array_to_string(list_filter(string_split(text, chr(10)), "
       f"lambda l: regexp_matches(l, '[^{_WS[1:-1]}]')), chr(10))) AS INTEGER) AS n_chars_kept FROM documents")
def f16_drop_blank_lines_docs(spark, sf_dir):
    d = TB.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.length(TX.drop_blank_lines("text")).alias("n_chars_kept"))


@query("f19_price_before_yen",
       Q.cte(w=Q.WEEKLY_ITEMS) + "SELECT category, CAST(sum(TRY_CAST(replace(price, ',', '') AS BIGINT)) AS BIGINT) AS total "
       "FROM w GROUP BY category")
def f19_price_before_yen(spark, sf_dir):
    """Older page layout: price text '1,200円' → the part before 円 → number."""
    w = TB.weekly_items(spark, sf_dir).withColumn("txt", F.concat("price", F.lit(TX.YEN_SUFFIX)))
    return w.groupBy("category").agg(F.sum(CL.to_long(TX.before_yen("txt"))).alias("total"))


# ---------------------------------------------------------------------------
# S12 daily bars from ticks


@query("s12_daily_bars_events",
       "SELECT event_type, CAST(ts AS DATE) AS Date, arg_min(value, (ts, event_id)) AS Open, "
       "max(value) AS High, min(value) AS Low, arg_max(value, (ts, event_id)) AS Close, "
       "count(value) AS Volume FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-31' "
       "GROUP BY 1, 2")
def s12_daily_bars_events(spark, sf_dir):
    e = TB.table(spark, sf_dir, "events")
    return bars.daily_bars(e, "event_type", "ts", "value", "event_id", "2024-01-01", "2024-01-31")
