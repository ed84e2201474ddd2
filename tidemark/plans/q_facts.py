"""Queries at item grain (one row per line item) and on the weekly-keyed items.

These run over the full fact table, so quantiles use the distributed exact
(rank-based) strategy and joins are left to Catalyst/AQE.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clean as CL
from ..functions import dates as DT
from ..operators import align as AL
from ..operators import models as M
from ..operators import stats as ST
from . import sqlkit as Q
from . import sqlstudy as QS
from . import tables as TB
from .catalog import query, rnd

# ---------------------------------------------------------------------------
# weekly keys → dates (F1, F2, F3) and the daily means the studies take from them

_WEEKLY = Q.cte(w=Q.WEEKLY_ITEMS)


def _first_monday_sql(legacy_before: int) -> str:
    f = "make_date(year + 2000, month, 1)"
    modern = f"{f} + CAST(((7 - (isodow({f}) - 1)) % 7) + 7 * (week - 1) AS INTEGER)"
    legacy = "make_date(year + 2000, month, CASE WHEN week = 1 THEN 5 WHEN week = 2 THEN 15 ELSE 25 END)"
    return (f"CASE WHEN year IS NULL OR month IS NULL OR week IS NULL THEN NULL "
            f"WHEN year < {legacy_before} AND month < 7 THEN {legacy} ELSE {modern} END")


_BLOCK_SQL = ("make_date(year + 2000, month, CASE WHEN year < 18 AND month < 7 THEN "
              "(CASE WHEN week = 1 THEN 5 WHEN week = 2 THEN 15 ELSE 25 END) "
              "WHEN week IS NULL THEN 1 ELSE least((week - 1) * 7 + 1, 28) END)")

_PRICE_SQL = "TRY_CAST(replace(trim(price), ',', '') AS BIGINT)"


def _weekly_daily(spark, sf_dir, rule: str, legacy_before: int):
    w = TB.weekly_prices(spark, sf_dir)
    d = w.select(DT.week_to_date("year", "month", "week", rule, legacy_before).alias("Date"),
                 CL.to_long("price").alias("price"))
    return d.where(F.col("Date").isNotNull()).groupBy("Date").agg(
        F.avg("price").alias("price"), F.count("price").alias("n"))


def _weekly_daily_sql(date_sql: str) -> str:
    return (_WEEKLY + f"SELECT Date, avg(p) AS price, count(p) AS n FROM (SELECT {date_sql} AS Date, "
            f"{_PRICE_SQL} AS p FROM w) WHERE Date IS NOT NULL GROUP BY Date")


@query("f1_week_date_first_monday", _weekly_daily_sql(_first_monday_sql(18)))
def f1_week_date_first_monday(spark, sf_dir):
    return _weekly_daily(spark, sf_dir, "first_monday", 18)


@query("f2_week_date_legacy_2018", _weekly_daily_sql(_first_monday_sql(2018)))
def f2_week_date_legacy_2018(spark, sf_dir):
    return _weekly_daily(spark, sf_dir, "first_monday", 2018)


@query("f3_week_date_block_rule", _weekly_daily_sql(_BLOCK_SQL))
def f3_week_date_block_rule(spark, sf_dir):
    return _weekly_daily(spark, sf_dir, "block", 18)


@query("p1p2_price_parse",
       _WEEKLY + "SELECT category, count(*) AS n, "
       "count(TRY_CAST(trim(price) AS DOUBLE)) AS n_lenient, "
       f"count({_PRICE_SQL}) AS n_stripped, CAST(sum({_PRICE_SQL}) AS BIGINT) AS sum_stripped FROM w GROUP BY category")
def p1p2_price_parse(spark, sf_dir):
    w = TB.weekly_items(spark, sf_dir)
    return w.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(CL.to_number("price")).alias("n_lenient"),
        F.count(CL.to_long("price")).alias("n_stripped"),
        F.sum(CL.to_long("price")).alias("sum_stripped"))


_DATE_TEXT_SQL = ("concat(CAST(year(o_orderdate) AS VARCHAR), '-', lpad(CAST(month(o_orderdate) * 2 AS VARCHAR), 2, '0'), "
                  "'-', lpad(CAST(day(o_orderdate) AS VARCHAR), 2, '0'))")


@query("p3_lenient_date_parse",
       f"SELECT count(*) AS n, count(d) AS n_valid, min(d) AS min_date, max(d) AS max_date FROM "
       f"(SELECT CAST(TRY_STRPTIME({_DATE_TEXT_SQL}, '%Y-%m-%d') AS DATE) AS d FROM orders)")
def p3_lenient_date_parse(spark, sf_dir):
    """Dates rebuilt as text with the month doubled: months 7–12 become impossible and
    must come back null, as ``to_datetime(errors="coerce")`` does."""
    o = TB.table(spark, sf_dir, "orders").select("o_orderdate")
    txt = F.concat_ws("-", F.year("o_orderdate").cast("string"),
                      F.lpad((F.month("o_orderdate") * 2).cast("string"), 2, "0"),
                      F.lpad(F.dayofmonth("o_orderdate").cast("string"), 2, "0"))
    d = o.select(CL.to_date_lenient(txt).alias("d"))
    return d.agg(F.count(F.lit(1)).alias("n"), F.count("d").alias("n_valid"),
                 F.min("d").alias("min_date"), F.max("d").alias("max_date"))


@query("p5u2_category_splits",
       _WEEKLY + "SELECT 'merged' AS output, count(*) AS n, CAST(sum(" + _PRICE_SQL + ") AS BIGINT) AS total FROM w "
       "UNION ALL SELECT 'only_brand1', count(*), CAST(sum(" + _PRICE_SQL + ") AS BIGINT) FROM w WHERE category = 'Brand#1' "
       "UNION ALL SELECT 'without_brand2', count(*), CAST(sum(" + _PRICE_SQL + ") AS BIGINT) FROM w "
       "WHERE category <> 'Brand#2' OR category IS NULL")
def p5u2_category_splits(spark, sf_dir):
    """One input, three outputs (all, == X, != Y keeping null categories)."""
    w = TB.weekly_items(spark, sf_dir).withColumn("p", CL.to_long("price"))
    outs = {"merged": F.lit(True), "only_brand1": CL.eq("category", "Brand#1"),
            "without_brand2": CL.ne_keep_null("category", "Brand#2")}
    # one pass: each output is a condition on the same rows
    sums = w.agg(*[x for k, cond in outs.items() for x in (
        F.count_if(cond).alias(f"n_{k}"), F.sum(F.when(cond, F.col("p"))).alias(f"t_{k}"))])
    return sums.select(F.inline(F.array(*[
        F.struct(F.lit(k).alias("output"), F.col(f"n_{k}").alias("n"), F.col(f"t_{k}").alias("total")) for k in outs])))


# ---------------------------------------------------------------------------
# item facts: quantiles, outliers, box, histogram, density

_ITEMS = Q.cte(it=Q.ITEMS)


@query("a8_quantiles_by_category",
       _ITEMS + "SELECT category, 'price' AS variable, count(price) AS n, "
       + ", ".join(f"round(quantile_cont(price, {p}), 4) AS q{int(p * 100)}"
                   for p in (0.05, 0.25, 0.5, 0.75, 0.95))
       + " FROM it GROUP BY category")
def a8_quantiles_by_category(spark, sf_dir):
    it = TB.item_facts(spark, sf_dir)
    q = ST.quantiles(it, ["price"], [0.05, 0.25, 0.5, 0.75, 0.95], by=["category"])
    return rnd(q, {c: 4 for c in ("q5", "q25", "q50", "q75", "q95")})


@query("a8_quantiles_items",
       _ITEMS + "SELECT 'price' AS variable, count(price) AS n, "
       + ", ".join(f"round(quantile_cont(price, {p}), 4) AS q{int(p * 100)}" for p in (0.25, 0.5, 0.75))
       + " FROM it")
def a8_quantiles_global(spark, sf_dir):
    it = TB.price_facts(spark, sf_dir)
    return rnd(ST.quantiles(it, ["price"], [0.25, 0.5, 0.75]),
               {c: 4 for c in ("q25", "q50", "q75")})


_IQR_SQL = (_ITEMS.rstrip() + ",\nb AS (SELECT quantile_cont(price, 0.25) AS q1, "
            "quantile_cont(price, 0.75) AS q3 FROM it)\n")


@query("a9_iqr_outliers_items",
       _IQR_SQL + "SELECT round(q1, 4) AS q1, round(q3, 4) AS q3, round(q3 - q1, 4) AS iqr, "
       "round(q1 - 1.5 * (q3 - q1), 4) AS lower, round(q3 + 1.5 * (q3 - q1), 4) AS upper, "
       "count(*) FILTER (WHERE price < q1 - 1.5 * (q3 - q1) OR price > q3 + 1.5 * (q3 - q1)) AS n_outliers, "
       "count(*) AS n, round(100.0 * count(*) FILTER (WHERE price < q1 - 1.5 * (q3 - q1) "
       "OR price > q3 + 1.5 * (q3 - q1)) / count(*), 6) AS outlier_pct FROM it, b GROUP BY q1, q3")
def a9_iqr_outliers_items(spark, sf_dir):
    it = TB.price_facts(spark, sf_dir)
    return rnd(ST.iqr_bounds(it, "price"), {"q1": 4, "q3": 4, "iqr": 4, "lower": 4, "upper": 4,
                                            "outlier_pct": 6})


@query("p6p9_clip_to_fences",
       _IQR_SQL + "SELECT category, round(avg(greatest(q1 - 1.5 * (q3 - q1), least(q3 + 1.5 * (q3 - q1), "
       "price))), 4) AS price_clipped, count(*) FILTER (WHERE price < q1 - 1.5 * (q3 - q1) "
       "OR price > q3 + 1.5 * (q3 - q1)) AS n_outside FROM it, b GROUP BY category")
def p6p9_clip_to_fences(spark, sf_dir):
    """Count rows outside the IQR fences (P6) and clip them."""
    it = TB.item_facts(spark, sf_dir)
    b = ST.iqr_bounds(it, "price").first()
    lo, hi = b["lower"], b["upper"]
    flagged = it.withColumn("_out", CL.outside("price", lo, hi))
    clipped = flagged.withColumn("price", CL.clip_col("price", lo, hi))
    out = clipped.groupBy("category").agg(F.avg("price").alias("price_clipped"),
                                          F.count_if("_out").alias("n_outside"))
    return rnd(out, {"price_clipped": 4})


@query("a14_box_by_category",
       _ITEMS.rstrip() + ",\nq AS (SELECT category, count(*) AS n, quantile_cont(price, 0.25) AS q1, "
       "quantile_cont(price, 0.5) AS median, quantile_cont(price, 0.75) AS q3 FROM it GROUP BY category)\n"
       "SELECT q.category, q.n, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, "
       "round(CAST(min(price) FILTER (WHERE price BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS DOUBLE), 4) AS whisker_lo, "
       "round(CAST(max(price) FILTER (WHERE price BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS DOUBLE), 4) AS whisker_hi, "
       "count(*) FILTER (WHERE NOT (price BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))) AS n_outliers "
       "FROM it JOIN q ON it.category = q.category GROUP BY q.category, q.n, q1, median, q3")
def a14_box_by_category(spark, sf_dir):
    it = TB.item_facts(spark, sf_dir)
    b = ST.box_stats(it, "price", by=["category"])
    return rnd(b, {c: 4 for c in ("q1", "median", "q3", "whisker_lo", "whisker_hi")})


_HIST_SQL = (_ITEMS.rstrip() + """,
x AS (SELECT CAST(price AS DOUBLE) AS v FROM it),
st AS (SELECT count(*) AS n, min(v) AS lo, max(v) AS hi, quantile_cont(v, 0.25) AS q1,
       quantile_cont(v, 0.75) AS q3 FROM x),
bw AS (SELECT *, (hi - lo) / (log2(n) + 1.0) AS sturges, 2.0 * (q3 - q1) * pow(n, -1.0 / 3.0) AS fd FROM st),
nb AS (SELECT *, CAST(ceil((hi - lo) / (CASE WHEN fd > 0 THEN least(fd, sturges) ELSE sturges END)) AS INTEGER) AS bins FROM bw),
c AS (SELECT CAST(least(bins - 1, floor((v - lo) * bins / (hi - lo))) AS BIGINT) AS bin, count(*) AS cnt FROM x, nb GROUP BY 1)
SELECT c.bin, CAST(bins AS BIGINT) AS n_bins, round(lo + c.bin * ((hi - lo) / bins), 4) AS lo,
       round(lo + (c.bin + 1) * ((hi - lo) / bins), 4) AS hi, CAST(c.cnt AS BIGINT) AS count
FROM nb, c
""")


@query("a15_histogram_items", _HIST_SQL)
def a15_histogram_items(spark, sf_dir):
    it = TB.price_facts(spark, sf_dir)
    return rnd(ST.histogram(it, "price"), {"lo": 4, "hi": 4})


_KDE_SQL = (_ITEMS.rstrip() + """,
x AS (SELECT CAST(price AS DOUBLE) AS v FROM it),
st AS (SELECT count(*) AS n, stddev_samp(v) * pow(count(*), -1.0 / 5.0) AS h, min(v) AS lo, max(v) AS hi FROM x),
g AS (SELECT CAST(i AS INTEGER) AS i, lo + i * ((hi - lo) / 199) AS gx FROM st, range(200) t(i))
SELECT g.i, round(gx, 4) AS x, round(sum(exp(-0.5 * ((gx - v) / h) * ((gx - v) / h))) * (1.0 / (n * h * sqrt(2 * pi()))), 15) AS density
FROM g, x, st GROUP BY g.i, gx, n, h
""")


@query("a16_kde_items", _KDE_SQL)
def a16_kde_items(spark, sf_dir):
    it = TB.price_facts(spark, sf_dir)
    return rnd(ST.kde_grid(it, "price"), {"x": 4, "density": 15})


# ---------------------------------------------------------------------------
# global and grouped summaries, trends


@query("a3_mean_count_by_year",
       _ITEMS + "SELECT CAST(year(Date) AS INTEGER) AS year, avg(price) AS mean, count(price) AS count FROM it "
       "WHERE Date IS NOT NULL GROUP BY 1")
def a3_mean_count_by_year(spark, sf_dir):
    it = TB.price_facts(spark, sf_dir).withColumn("year", F.year("Date"))
    return ST.mean_count_by(it, "year", "price")


@query("a4_global_summary_items",
       _ITEMS + "SELECT min(price) AS min, max(price) AS max, avg(price) AS mean, count(*) AS n FROM it")
def a4_global_summary_items(spark, sf_dir):
    return ST.global_summary(TB.price_facts(spark, sf_dir), "price")


@query("a5_min_date_across_tables",
       Q.cte(daily=Q.DAILY, rates=Q.RATES)
       + "SELECT min(Date) AS min FROM (SELECT Date FROM daily UNION ALL SELECT Date FROM rates)")
def a5_min_date_across_tables(spark, sf_dir):
    return ST.min_across([TB.daily_price(spark, sf_dir), TB.rates_wide(spark, sf_dir)], "Date")


@query("a13_categories_first_seen",
       _ITEMS + "SELECT category, row_number() OVER (ORDER BY fd, fo, fl) AS seq FROM ("
       "SELECT category, arg_min(Date, (Date, l_orderkey, l_linenumber)) AS fd, "
       "arg_min(l_orderkey, (Date, l_orderkey, l_linenumber)) AS fo, "
       "arg_min(l_linenumber, (Date, l_orderkey, l_linenumber)) AS fl FROM it "
       "WHERE category IS NOT NULL GROUP BY category)")
def a13_categories_first_seen(spark, sf_dir):
    """Distinct categories numbered in order of first appearance."""
    it = TB.item_facts(spark, sf_dir)
    first = ST.distinct_first_seen(it, "category", ["Date", "l_orderkey", "l_linenumber"])
    r = M.global_rank(first, "_first", numeric=F.unix_date(F.col("_first.Date")))
    return r.select("category", (F.col("_rank") + 1).alias("seq"))


_TREND_SQL = Q.cte(daily=Q.DAILY, x="SELECT CAST(date_diff('day', DATE '1970-01-01', Date) AS DOUBLE) AS x, price AS y FROM daily")


def _linregress_sql(src: str, group: str = "") -> str:
    g_sel = f"{group}, " if group else ""
    g_by = f" GROUP BY {group}" if group else ""
    r = "(regr_sxy(y, x) / sqrt(regr_sxx(y, x) * regr_syy(y, x)))"
    se = f"sqrt((1 - {r} * {r}) * regr_syy(y, x) / (regr_sxx(y, x) * (regr_count(y, x) - 2)))"
    return (f"SELECT {g_sel}CAST(regr_count(y, x) AS BIGINT) AS n, round(regr_slope(y, x), 9) AS slope, "
            f"round(regr_avgy(y, x) - regr_slope(y, x) * regr_avgx(y, x), 6) AS intercept, "
            f"round({r}, 9) AS rvalue, round({se}, 9) AS stderr, "
            f"round({se} * sqrt(sum(x * x) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) / regr_count(y, x)), 6) "
            f"AS intercept_stderr FROM {src}{g_by}")


_LR_ROUND = {"slope": 9, "intercept": 6, "rvalue": 9, "stderr": 9, "intercept_stderr": 6}


def _daily_trend(spark, sf_dir):
    d = TB.daily_price(spark, sf_dir)
    return d.select(DT.days_since_epoch("Date").cast("double").alias("x"), F.col("price").alias("y"))


@query("a11_linregress_daily_trend", _TREND_SQL + _linregress_sql("x"))
def a11_linregress_daily_trend(spark, sf_dir):
    lr = ST.linregress(_daily_trend(spark, sf_dir), "x", "y").drop("pvalue")
    return rnd(lr, _LR_ROUND)


def _p_value_sql(src: str, group: str = "") -> str:
    """The two-sided p-value of each group's slope, to nine digits."""
    key = f"{group}, " if group else ""
    return (f"SELECT {key}round(CASE WHEN abs(r) < 1 THEN {QS.two_sided('r * sqrt(v / (1 - r * r))', 'v')} ELSE 0 END, 9) AS pvalue FROM ("
            f"SELECT {key}regr_sxy(y, x) / sqrt(regr_sxx(y, x) * regr_syy(y, x)) AS r, regr_count(y, x) - 2.0 AS v FROM {src}"
            + (f" GROUP BY {group}" if group else "") + ")")


@query("a11_linregress_full",
       _TREND_SQL + f"SELECT l.*, p.pvalue FROM ({_linregress_sql('x')}) l, ({_p_value_sql('x')}) p")
def a11_linregress_full(spark, sf_dir):
    """With the two-sided p-value (the t tail is a column expression)."""
    return rnd(ST.linregress(_daily_trend(spark, sf_dir), "x", "y"), {**_LR_ROUND, "pvalue": 9})


_DISCOUNTS = ("WITH x AS (SELECT l_partkey % 50 AS g, CAST(l_discount AS DOUBLE) AS x, "
              f"CAST({Q.cents('l_extendedprice')} AS DOUBLE) AS y FROM lineitem WHERE l_quantity > 30)\n")


@query("a11_p_values_by_group", _DISCOUNTS + _p_value_sql("x", "g"))
def a11_p_values_by_group(spark, sf_dir):
    """Fifty groups' p-values of price on discount, all in the JVM."""
    li = TB.table(spark, sf_dir, "lineitem").where("l_quantity > 30")
    x = li.select((F.col("l_partkey") % 50).alias("g"), F.col("l_discount").cast("double").alias("x"),
                  TB.cents("l_extendedprice").cast("double").alias("y"))
    return rnd(ST.linregress(x, "x", "y", by=["g"]).select("g", "pvalue"), {"pvalue": 9})


@query("a11_linregress_by_category",
       _ITEMS.rstrip() + ",\nx AS (SELECT category, CAST(date_diff('day', (SELECT min(Date) FROM it), Date) AS DOUBLE) AS x, "
       "CAST(price AS DOUBLE) AS y FROM it)\n" + _linregress_sql("x", "category"))
def a11_linregress_by_category(spark, sf_dir):
    """Price trend per category on days from the table's first date."""
    it = TB.item_facts(spark, sf_dir)
    first = it.agg(F.min("Date")).first()[0]
    x = it.select("category", DT.days_from("Date", first).cast("double").alias("x"),
                  F.col("price").cast("double").alias("y"))
    return rnd(ST.linregress(x, "x", "y", by=["category"]).drop("pvalue"), _LR_ROUND)


@query("p15_trend_line",
       _TREND_SQL.rstrip() + ",\nf AS (SELECT regr_slope(y, x) AS s, regr_avgy(y, x) - regr_slope(y, x) * regr_avgx(y, x) AS b FROM x)\n"
       "SELECT Date, round(s * CAST(date_diff('day', DATE '1970-01-01', Date) AS DOUBLE) + b, 4) AS trend FROM daily, f")
def p15_trend_line(spark, sf_dir):
    d = TB.daily_price(spark, sf_dir)
    fit = ST.linregress(_daily_trend(spark, sf_dir), "x", "y").first()
    out = d.select("Date", CL.linear_trend(DT.days_since_epoch("Date"), fit["slope"], fit["intercept"])
                   .alias("trend"))
    return rnd(out, {"trend": 4})


@query("f6_days_from_first",
       Q.cte(daily=Q.DAILY) + "SELECT Date, CAST(date_diff('day', (SELECT min(Date) FROM daily), Date) AS INTEGER) "
       "AS day_no FROM daily")
def f6_days_from_first(spark, sf_dir):
    d = TB.daily_price(spark, sf_dir)
    first = d.agg(F.min("Date")).first()[0]
    return d.select("Date", DT.days_from("Date", first).alias("day_no"))


@query("f9_tick_labels",
       Q.cte(daily=Q.DAILY, b="SELECT min(Date) AS d0, date_diff('day', min(Date), max(Date)) AS span FROM daily")
       + "SELECT CAST(o AS INTEGER) AS offset, strftime(d0 + CAST(o AS INTEGER), '%Y年%m月') AS label "
       "FROM b, generate_series(0, span + 179, 180) t(o)")
def f9_tick_labels(spark, sf_dir):
    """analyze-fix.py: ticks every 180 days from the first date, labelled YYYY年MM月."""
    d = TB.daily_price(spark, sf_dir)
    b = d.agg(F.min("Date").alias("d0"), F.datediff(F.max("Date"), F.min("Date")).alias("span"))
    t = b.select("d0", F.explode(DT.tick_offsets(F.col("span"), 180)).alias("offset"))
    return t.select(F.col("offset").cast("int"), DT.month_label(F.col("d0"), F.col("offset")).alias("label"))


@query("f22_mean_count_labels",
       _WEEKLY + "SELECT category, format('{:.1f}円\n({:d}件)', round(avg(" + _PRICE_SQL + "), 1), "
       "count(" + _PRICE_SQL + ")) AS label FROM w GROUP BY category")
def f22_mean_count_labels(spark, sf_dir):
    from ..functions.text import mean_count_label
    w = TB.weekly_items(spark, sf_dir).withColumn("p", CL.to_long("price"))
    a = w.groupBy("category").agg(F.avg("p").alias("m"), F.count("p").alias("c"))
    return a.select("category", mean_count_label("m", "c").alias("label"))


# ---------------------------------------------------------------------------
# entry 1 of the reference: the item table with nearest rates and the month's side value


def side_two_files(spark, sf_dir):
    """Two side 'files' that overlap on every month; ordered by file name (Q20)."""
    o = TB.table(spark, sf_dir, "orders").select("o_orderdate", "o_totalprice", "o_orderpriority")
    files = {"gasoline_b1.csv": TB.SIDE_PRIORITY, "gasoline_gs2.csv": "4-NOT SPECIFIED"}
    return (o.where(F.col("o_orderpriority").isin(*files.values()))
            .groupBy(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"),
                     F.when(F.col("o_orderpriority") == TB.SIDE_PRIORITY, "gasoline_b1.csv")
                     .otherwise("gasoline_gs2.csv").alias("file"))
            .agg((F.avg(TB.cents("o_totalprice")) / 100.0).alias("Gasoline")))


_SIDE2_SQL = (f"SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, "
              f"CASE WHEN o_orderpriority = '{TB.SIDE_PRIORITY}' THEN 'gasoline_b1.csv' ELSE 'gasoline_gs2.csv' END AS file, "
              f"AVG({Q.cents('o_totalprice')}) / 100.0 AS Gasoline FROM orders "
              f"WHERE o_orderpriority IN ('{TB.SIDE_PRIORITY}', '4-NOT SPECIFIED') GROUP BY 1, 2, 3")
_SIDE_FIRST_SQL = "SELECT year, month, arg_min(Gasoline, file) AS Gasoline FROM side2 GROUP BY 1, 2"


@query("j3_first_match_side",
       Q.cte(daily=Q.DAILY, side2=_SIDE2_SQL, sf=_SIDE_FIRST_SQL)
       + "SELECT Date, sf.Gasoline FROM daily LEFT JOIN sf ON sf.year = year(daily.Date) "
       "AND sf.month = month(daily.Date)")
def j3_first_match_side(spark, sf_dir):
    d = TB.daily_price(spark, sf_dir).select("Date", F.year("Date").alias("year"),
                                             F.month("Date").alias("month"))
    j = AL.first_match(d, side_two_files(spark, sf_dir), ["year", "month"], ["Gasoline"], order="file")
    return j.select("Date", "Gasoline")


_M21_SQL = Q.cte(it=Q.ITEMS, rates=Q.RATES, side2=_SIDE2_SQL, sf=_SIDE_FIRST_SQL,
                nr=Q.nearest("it", "rates", "l.l_orderkey, l.l_linenumber, l.Date, l.name, l.price, l.category",
                             Q.RATE_NAMES),
                m21="SELECT nr.*, sf.Gasoline FROM nr LEFT JOIN sf ON sf.year = year(nr.Date) "
                    "AND sf.month = month(nr.Date)")


@query("m21_merged_all", _M21_SQL + "SELECT * FROM m21")
def m21_merged_all(spark, sf_dir):
    """a.py: every item with the nearest day's (unfilled) rates and its month's side value."""
    return merged_all(spark, sf_dir)


def merged_all(spark, sf_dir):
    from ..session import cut_lineage
    it = TB.item_facts(spark, sf_dir)
    # day-grain rates: read twice below (keys and payload), so materialised once
    rates = cut_lineage(TB.rates_wide_one_scan(spark, sf_dir))
    j = AL.asof_nearest(it, rates, on="Date", payload=Q.RATE_NAMES)
    j = j.withColumns({"year": F.year("Date"), "month": F.month("Date")})
    # one row per calendar month after de-duplication: checked, then broadcast
    j = AL.first_match(j, side_two_files(spark, sf_dir), ["year", "month"], ["Gasoline"], order="file",
                       max_right_rows=100_000)
    return j.drop("year", "month")


@query("j5_nearest_levels_and_changes",
       Q.cte(daily=Q.DAILY, rates=Q.RATES, filled=Q.filled(),
             ch=Q.pct_sql("filled", Q.RATE_NAMES, first_zero=True),
             lv="SELECT f.*, " + ", ".join(f"ch.{c} AS {c}_pct" for c in Q.RATE_NAMES)
             + " FROM filled f JOIN ch ON f.Date = ch.Date",
             nr=Q.nearest("daily", "lv", "l.Date, l.price",
                          Q.RATE_NAMES + [c + "_pct" for c in Q.RATE_NAMES]))
       + "SELECT * FROM nr")
def j5_nearest_levels_and_changes(spark, sf_dir):
    """One nearest lookup returning both the levels and the changes."""
    from ..session import cut_lineage
    # day-grain levels and changes, read twice by the nearest join: materialised once
    rates = AL.fill_both(TB.rates_wide_one_scan(spark, sf_dir), "Date", buckets=1)
    both = cut_lineage(AL.pct_change(rates, "Date", Q.RATE_NAMES, first_zero=True, suffix="_pct",
                                     buckets=1))
    return AL.asof_nearest(TB.daily_price(spark, sf_dir), both, on="Date")


# ---------------------------------------------------------------------------
# sorts, heads, unions


@query("o1_sorted_panel_dates", Q.cte(daily=Q.DAILY) + "SELECT Date, price FROM daily ORDER BY Date")
def o1_sorted_panel_dates(spark, sf_dir):
    return TB.daily_price(spark, sf_dir).orderBy("Date")


@query("o2_sorted_side_monthly", Q.cte(s=Q.SIDE_MONTHLY) + "SELECT * FROM s ORDER BY year, month")
def o2_sorted_side_monthly(spark, sf_dir):
    return TB.side_monthly(spark, sf_dir).orderBy("year", "month")


@query("o6_head5_items", _ITEMS + "SELECT * FROM it ORDER BY Date, l_orderkey, l_linenumber LIMIT 5")
def o6_head5_items(spark, sf_dir):
    """head(5) after an explicit order."""
    from ..sources.sinks import preview
    return preview(TB.item_facts(spark, sf_dir), 5, ["Date", "l_orderkey", "l_linenumber"])


@query("u1_union_rate_files",
       "\nUNION ALL\n".join(f"SELECT Date, '{n}' AS pair, {n} AS close FROM ({Q.rate_series(n)})"
                            for n in Q.RATE_NAMES))
def u1_union_rate_files(spark, sf_dir):
    out = None
    for n in Q.RATE_NAMES:
        s = TB.rate_series(spark, sf_dir, n).select("Date", F.lit(n).alias("pair"), F.col(n).alias("close"))
        out = s if out is None else out.unionByName(s)
    return out


def _qq_sql():
    from .q_study import _PCT_SQL
    ranked = ("SELECT Date, price, row_number() OVER (ORDER BY price, Date) AS i, count(*) OVER () AS n, "
              "avg(price) OVER () AS m, stddev_pop(price) OVER () AS s FROM pct")
    p = "(CAST(i AS DOUBLE) / (n + 1))"
    return (_PCT_SQL.rstrip() + f",\nrk AS ({ranked})\n"
            f"SELECT Date, i, round({Q.norm_ppf_sql(p)}, 5) AS theoretical, "
            f"round((price - m) / s, 6) AS sample FROM rk")


@query("w7_qq_pct_price", _qq_sql())
def w7_qq_pct_price(spark, sf_dir):
    from .q_study import pct_panel
    q = M.qq_pairs(pct_panel(spark, sf_dir), "price", "Date", buckets=1)  # one row per day
    return rnd(q.withColumn("i", F.col("i").cast("long")), {"theoretical": 5, "sample": 6})
