"""Extreme, infinite and missing values in the operators that meet them.

The driver tables hold neither NaN nor infinities, so these queries derive them: NaN for one line
number in three (a missing value for every operator, null in the SQL), and numbers from the
smallest denormal ones to the largest, with both infinities, for exact selection.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import models as M
from ..operators import scale as SC
from ..operators import stats as ST
from . import sqlkit as Q
from . import tables as TB
from .catalog import query, rnd

# ---------------------------------------------------------------------------
# exact selection

_PROBS = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)
_NAMES = [f"q{int(p * 100)}" for p in _PROBS]

_EXTREME = f"""SELECT l_orderkey AS g, CASE l_linenumber % 7 WHEN 0 THEN c * 1e300 WHEN 1 THEN -c * 1e300 WHEN 2 THEN c * 1e-318
WHEN 3 THEN -c * 1e-318 WHEN 4 THEN 'inf'::DOUBLE * (CASE WHEN l_orderkey % 3 = 0 THEN -1 ELSE 1 END) WHEN 5 THEN c WHEN 6 THEN 0.0 END AS v
FROM (SELECT l_orderkey, l_linenumber, CAST({Q.cents('l_extendedprice')} AS DOUBLE) AS c FROM lineitem)"""


def _extreme(spark, sf_dir):
    li = TB.table(spark, sf_dir, "lineitem")
    c = TB.cents("l_extendedprice").cast("double")
    inf = F.lit(float("inf")) * F.when(F.col("l_orderkey") % 3 == 0, -1).otherwise(1)
    v = F.lit(0.0)
    for k, x in enumerate([c * 1e300, -c * 1e300, c * 1e-318, -c * 1e-318, inf, c]):
        v = F.when(F.col("l_linenumber") % 7 == k, x).otherwise(v)
    return li.select(F.col("l_orderkey").alias("g"), v.alias("v"))


def _shown(q):
    """Numbers a digest can tell apart: tiny ones times 1e310, infinities as 1.5e308 with their sign."""
    return f"CASE WHEN abs({q}) > 1.7e308 THEN sign({q}) * 1.5e308 WHEN abs({q}) < 1e-290 THEN {q} * 1e300 * 1e10 ELSE {q} END"


def _select_sql(group: str) -> str:
    part = f"PARTITION BY {group} " if group else ""
    at = lambda f, p: f"max(v) FILTER (WHERE r = {f}((n - 1) * {p}))"
    mixed = []
    for p, name in zip((f"CAST({p} AS DOUBLE)" for p in _PROBS), _NAMES):
        lo, hi, s = f"lo_{name}", f"hi_{name}", f"((n - 1) * {p} - floor((n - 1) * {p}))"
        value = (f"CASE WHEN {lo} = {hi} OR {s} = 0 THEN {lo} WHEN isinf({hi} - {lo}) THEN CASE WHEN isnan({lo} * (1.0 - {s}) + {hi} * {s}) "
                 f"THEN NULL ELSE {lo} * (1.0 - {s}) + {hi} * {s} END ELSE {lo} + ({hi} - {lo}) * {s} END")
        mixed.append((f"{at('floor', p)} AS {lo}, {at('ceil', p)} AS {hi}", f"{value} AS {name}"))
    key = f"{group}, " if group else ""
    return (f"WITH v AS ({_EXTREME}),\nr AS (SELECT *, row_number() OVER ({part}ORDER BY v) - 1 AS r, count(*) OVER ({part}) AS n FROM v),\n"
            f"e AS (SELECT {key}n, {', '.join(a for a, _ in mixed)} FROM r GROUP BY {key}n),\nq AS (SELECT {key}n, {', '.join(b for _, b in mixed)} FROM e)\n"
            f"SELECT {key}'v' AS variable, n, {', '.join(f'{_shown(x)} AS {x}' for x in _NAMES)} FROM q")


def _selected(q):
    return q.withColumns({c: F.expr(_shown(c)) for c in _NAMES})


@query("a8_quantiles_extreme_groups", _select_sql("g"))
def a8_quantiles_extreme_groups(spark, sf_dir):
    """One group per order (15 000 at sf0.01): denormal, huge and infinite values of both signs."""
    return _selected(ST.quantiles(_extreme(spark, sf_dir), ["v"], _PROBS, by=["g"]))


@query("a8_quantiles_extreme_items", _select_sql(""))
def a8_quantiles_extreme_items(spark, sf_dir):
    return _selected(ST.quantiles(_extreme(spark, sf_dir), ["v"], _PROBS))


# ---------------------------------------------------------------------------
# NaN is missing

_GAPPY = f"""it AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 <> 0 THEN CAST({Q.cents('l_extendedprice')} AS DOUBLE) END AS price,
CASE WHEN l_linenumber % 4 <> 1 THEN CAST(l_quantity AS DOUBLE) END AS quantity, CAST(l_discount AS DOUBLE) AS discount, l_returnflag AS flag
FROM lineitem)"""
_GAP_COLS = ["price", "quantity", "discount"]


def _gappy(spark, sf_dir):
    li = TB.table(spark, sf_dir, "lineitem")
    nan = F.lit(float("nan"))
    return li.select("l_orderkey", "l_linenumber",
                     F.when(F.col("l_linenumber") % 3 != 0, TB.cents("l_extendedprice").cast("double")).otherwise(nan).alias("price"),
                     F.when(F.col("l_linenumber") % 4 != 1, F.col("l_quantity").cast("double")).otherwise(nan).alias("quantity"),
                     F.col("l_discount").cast("double").alias("discount"), F.col("l_returnflag").alias("flag"))


@query("a9_iqr_nan_prices",
       f"WITH {_GAPPY}, b AS (SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM it) "
       "SELECT round(q1, 4) AS q1, round(q3, 4) AS q3, round(q3 - q1, 4) AS iqr, round(q1 - 0.5 * (q3 - q1), 4) AS lower, "
       "round(q3 + 0.5 * (q3 - q1), 4) AS upper, count(*) FILTER (WHERE price < q1 - 0.5 * (q3 - q1) OR price > q3 + 0.5 * (q3 - q1)) AS n_outliers, "
       "count(*) AS n, round(100.0 * count(*) FILTER (WHERE price < q1 - 0.5 * (q3 - q1) OR price > q3 + 0.5 * (q3 - q1)) / count(*), 6) "
       "AS outlier_pct FROM it, b GROUP BY q1, q3")
def a9_iqr_nan_prices(spark, sf_dir):
    return rnd(ST.iqr_bounds(_gappy(spark, sf_dir), "price", k=0.5),
               {"q1": 4, "q3": 4, "iqr": 4, "lower": 4, "upper": 4, "outlier_pct": 6})


@query("a14_box_nan_prices",
       f"WITH {_GAPPY}, q AS (SELECT flag, count(price) AS n, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.5) AS median, "
       "quantile_cont(price, 0.75) AS q3 FROM it GROUP BY flag) SELECT q.flag, q.n, round(q1, 4) AS q1, round(median, 4) AS median, "
       "round(q3, 4) AS q3, round(min(price) FILTER (WHERE price BETWEEN q1 - 0.5 * (q3 - q1) AND q3 + 0.5 * (q3 - q1)), 4) AS whisker_lo, "
       "round(max(price) FILTER (WHERE price BETWEEN q1 - 0.5 * (q3 - q1) AND q3 + 0.5 * (q3 - q1)), 4) AS whisker_hi, "
       "count(*) FILTER (WHERE NOT (price BETWEEN q1 - 0.5 * (q3 - q1) AND q3 + 0.5 * (q3 - q1))) AS n_outliers "
       "FROM it JOIN q ON it.flag = q.flag GROUP BY q.flag, q.n, q1, median, q3")
def a14_box_nan_prices(spark, sf_dir):
    b = ST.box_stats(_gappy(spark, sf_dir), "price", by=["flag"], whis=0.5)
    return rnd(b, {c: 4 for c in ("q1", "median", "q3", "whisker_lo", "whisker_hi")})


@query("a15_histogram_nan_prices",
       f"WITH {_GAPPY}, s AS (SELECT min(price) AS lo, max(price) AS hi FROM it) SELECT "
       "CAST(least(9, floor((price - lo) * 10 / (hi - lo))) AS BIGINT) AS bin, count(*) AS count FROM it, s WHERE price IS NOT NULL GROUP BY 1")
def a15_histogram_nan_prices(spark, sf_dir):
    return ST.histogram(_gappy(spark, sf_dir), "price", bins=10).select("bin", "count")


@query("a16_kde_nan_prices",
       f"WITH {_GAPPY}, st AS (SELECT count(price) AS n, stddev_samp(price) * pow(count(price), -1.0 / 5.0) AS h, min(price) AS lo, "
       "max(price) AS hi FROM it), g AS (SELECT CAST(i AS INTEGER) AS i, lo + i * ((hi - lo) / 49) AS gx FROM st, range(50) t(i)) "
       "SELECT g.i, round(gx, 4) AS x, round(1e9 * sum(exp(-0.5 * ((gx - price) / h) * ((gx - price) / h))) / (n * h * sqrt(2 * pi())), 6) AS density "
       "FROM g, it, st WHERE price IS NOT NULL GROUP BY g.i, gx, n, h")
def a16_kde_nan_prices(spark, sf_dir):
    k = ST.kde_grid(_gappy(spark, sf_dir), "price", grid_size=50)
    return rnd(k.withColumn("density", F.col("density") * 1e9), {"x": 4, "density": 6})


@query("a10_corr_nan_items", f"WITH {_GAPPY}\n" + Q.corr_long("it", _GAP_COLS))
def a10_corr_nan_items(spark, sf_dir):
    return rnd(ST.corr_long(_gappy(spark, sf_dir), _GAP_COLS), {"pearson_r": 9})


@query("a11_linregress_nan_items",
       f"WITH {_GAPPY} SELECT flag, CAST(regr_count(price, quantity) AS BIGINT) AS n, round(regr_slope(price, quantity), 4) AS slope, "
       "round(regr_intercept(price, quantity), 3) AS intercept, round(corr(price, quantity), 9) AS rvalue FROM it GROUP BY flag")
def a11_linregress_nan_items(spark, sf_dir):
    r = ST.linregress(_gappy(spark, sf_dir), "quantity", "price", by=["flag"])
    return rnd(r.select("flag", "n", "slope", "intercept", "rvalue"), {"slope": 4, "intercept": 3, "rvalue": 9})


@query("m1m2m3_scalers_nan_items", f"WITH {_GAPPY}\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS variable, round(avg({c}), 5) AS mean, round(stddev_pop({c}), 5) AS std, round(min({c}), 5) AS lo, "
    f"round(max({c}) - min({c}), 5) AS span, round(quantile_cont({c}, 0.5), 5) AS median, "
    f"round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 5) AS iqr FROM it" for c in _GAP_COLS))
def m1m2m3_scalers_nan_items(spark, sf_dir):
    d = _gappy(spark, sf_dir)
    fits = [f(d, _GAP_COLS).to_df(spark) for f in (SC.fit_standard, SC.fit_minmax, SC.fit_robust)]
    names = [("mean", "std"), ("lo", "span"), ("median", "iqr")]
    out = None
    for f, (a, b) in zip(fits, names):
        part = f.select("variable", F.round("center", 5).alias(a), F.round("scale", 5).alias(b))
        out = part if out is None else out.join(part, "variable")
    return out


@query("m5_ols_nan_items",
       f"WITH {_GAPPY}, c AS (SELECT * FROM it WHERE price IS NOT NULL AND quantity IS NOT NULL AND discount IS NOT NULL), "
       "m AS (SELECT covar_pop(quantity, quantity) AS a, covar_pop(quantity, discount) AS b, covar_pop(discount, discount) AS d, "
       "covar_pop(quantity, price) AS e, covar_pop(discount, price) AS f, avg(quantity) AS mq, avg(discount) AS md, avg(price) AS mp FROM c), "
       "w AS (SELECT *, (d * e - b * f) / (a * d - b * b) AS w1, (a * f - b * e) / (a * d - b * b) AS w2 FROM m) "
       "SELECT 'const' AS feature, round(mp - w1 * mq - w2 * md, 3) AS coef FROM w UNION ALL SELECT 'quantity', round(w1, 4) FROM w "
       "UNION ALL SELECT 'discount', round(w2, 2) FROM w")
def m5_ols_nan_items(spark, sf_dir):
    fit = M.ols(_gappy(spark, sf_dir), ["quantity", "discount"], "price").coef_df(spark)
    digits = F.when(F.col("feature") == "const", F.round("coef", 3)).when(F.col("feature") == "quantity", F.round("coef", 4)) \
        .otherwise(F.round("coef", 2))
    return fit.select("feature", digits.alias("coef"))


# ---------------------------------------------------------------------------
# many columns, dependent columns

_WIDE = [f"f{k}" for k in range(40)]


def _wide_value(k: int) -> str:
    """Forty columns of items, each missing in other rows; f7 is constant and f8 always missing."""
    if k == 7:
        return "CAST(3 AS DOUBLE)"
    if k == 8:
        return "CAST(NULL AS DOUBLE)"
    value = f"CAST((l_partkey * {k % 5 + 1} + l_suppkey * {k % 7} + l_linenumber * {k}) % {61 + 2 * k} AS DOUBLE)"
    return f"CASE WHEN (l_orderkey + {k}) % {9 + k % 4} <> 0 THEN {value} END"


_WIDE_CTE = "WITH w AS (SELECT " + ", ".join(f"{_wide_value(k)} AS {c}" for k, c in enumerate(_WIDE)) + " FROM lineitem)\n"


@query("a10_corr_wide_items",
       _WIDE_CTE + ", a AS (SELECT " + ", ".join(f"corr({x}, {y}) AS {x}_{y}" for i, x in enumerate(_WIDE) for y in _WIDE[i:]) + " FROM w)\n"
       + "SELECT var_x, var_y, CASE WHEN isnan(r) THEN NULL ELSE round(r, 9) END AS pearson_r FROM (SELECT unnest(["
       + ", ".join(f"{{'var_x': '{x}', 'var_y': '{y}', 'r': {min(x, y, key=lambda c: int(c[1:]))}_{max(x, y, key=lambda c: int(c[1:]))}}}"
                   for x in _WIDE for y in _WIDE) + "], recursive := true) FROM a)")
def a10_corr_wide_items(spark, sf_dir):
    w = TB.table(spark, sf_dir, "lineitem").select(*[F.expr(_wide_value(k)).alias(c) for k, c in enumerate(_WIDE)])
    return rnd(ST.corr_long(w, _WIDE), {"pearson_r": 9})


_DEP = f"""d AS (SELECT CAST(l_quantity AS DOUBLE) AS a, 2 * CAST(l_quantity AS DOUBLE) AS a2, CAST(l_discount AS DOUBLE) AS c,
CAST(l_tax AS DOUBLE) AS t FROM lineitem)"""
_PAIR = ["a", "c", "t"]


def _dependent_sql(constant: bool) -> str:
    """a and 2a are infinite; the others' values are those without 2a.  Infinite ones are shown as -1."""
    ii = {(i, j): f"i{min(i, j)}{max(i, j)}" for i in range(3) for j in range(3)}
    src = Q.gram3_sql("d", _PAIR, None)
    if constant:
        quad = " + ".join(f"m{i} * {ii[i, j]} * m{j}" for i in range(3) for j in range(3))
        parts = [f"SELECT 'const' AS feature, round(1 + {quad}, 6) AS vif FROM inv"]
        ctes = f"WITH {_DEP}, g AS ({src}), inv AS ({Q.inv3_sql('g')})\n"
    else:
        parts = []
        u = "SELECT n, " + ", ".join(f"s{i}{j} + m{i} * m{j} AS s{i}{j}" for i in range(3) for j in range(i, 3)) + " FROM g"
        ctes = f"WITH {_DEP}, g AS ({src}), u AS ({u}), inv AS ({Q.inv3_sql('u')})\n"
    parts += [f"SELECT '{c}' AS feature, round(s{k}{k} * i{k}{k}, 6) AS vif FROM inv" for k, c in ((1, "c"), (2, "t"))]
    return ctes + " UNION ALL ".join(parts + [f"SELECT '{c}', -1.0" for c in ("a", "a2")])


def _dependent(spark, sf_dir, constant: bool):
    d = TB.table(spark, sf_dir, "lineitem").select(
        F.col("l_quantity").cast("double").alias("a"), (2 * F.col("l_quantity").cast("double")).alias("a2"),
        F.col("l_discount").cast("double").alias("c"), F.col("l_tax").cast("double").alias("t"))
    v = M.vif_df(spark, M.vif(d, ["a", "a2", "c", "t"], constant=constant))
    return v.select("feature", F.when(F.col("vif") == float("inf"), -1.0).otherwise(F.round("vif", 6)).alias("vif"))


@query("m11_vif_dependent_items", _dependent_sql(True))
def m11_vif_dependent_items(spark, sf_dir):
    """Two columns depend on each other; the constant and the other columns keep finite factors."""
    return _dependent(spark, sf_dir, True)


@query("m12_vif_dependent_items", _dependent_sql(False))
def m12_vif_dependent_items(spark, sf_dir):
    return _dependent(spark, sf_dir, False)
