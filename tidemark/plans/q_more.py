"""Studies that combine operators: linear models of the item grid with SQL oracles, the panel's
three variants, residuals of the test rows, shared axes, and small operators on their own."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import clean as CL
from ..functions import text as TX
from ..operators import align as AL
from ..operators import models as M
from ..operators import stats as ST
from ..session import scratch_path
from ..sources import delimited, html, surveys
from . import sqlkit as Q
from . import tables as TB
from .catalog import panel, query, rnd
from .q_facts import _M21_SQL, _SIDE2_SQL, _SIDE_FIRST_SQL, side_two_files
from .q_sources import _SURVEY_SQL, _survey_rows
from .q_study import COLS4, GRID_FEATS, X3, grid_fits, mm_panel, mm_split, pct_panel, std_panel

# ---------------------------------------------------------------------------
# the linear models of the grid, solved in SQL by elimination


def _solve_ctes(src: str, p: int, tag: str) -> str:
    """CTEs that turn rows (..., a00..a{p-1}{p}) of ``src`` into ones with solutions x0..x{p-1}."""
    out, now = [], src
    for k in range(p):
        cells = []
        for i in range(p):
            for j in range(p + 1):
                if i > k:
                    cells.append(f"a{i}{j} - a{i}{k} / a{k}{k} * a{k}{j} AS a{i}{j}")
                else:
                    cells.append(f"a{i}{j}")
        out.append(f"{tag}{k} AS (SELECT * EXCLUDE ({', '.join(f'a{i}{j}' for i in range(p) for j in range(p + 1))}), {', '.join(cells)} FROM {now})")
        now = f"{tag}{k}"
    for i in range(p - 1, -1, -1):
        known = "".join(f" - a{i}{j} * x{j}" for j in range(i + 1, p))
        out.append(f"{tag}x{i} AS (SELECT *, (a{i}{p}{known}) / a{i}{i} AS x{i} FROM {now})")
        now = f"{tag}x{i}"
    return ",\n".join(out)


def _grid_ctes() -> str:
    """Complete rows, fences, split, scalings and the four linear fits, named ``sol``."""
    f = GRID_FEATS
    p = len(f)
    where = " AND ".join(f"{c} IS NOT NULL" for c in f + ["price"])
    st = ", ".join(f"avg({c}) AS c_{c}, stddev_pop({c}) AS s_{c}, quantile_cont({c}, 0.5) AS m_{c}, "
                   f"quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS i_{c}" for c in f)
    scaled = " UNION ALL ".join(
        f"SELECT '{label}' AS scaling, is_test, y, " + ", ".join(f"({c} - {a}_{c}) / {b}_{c} AS {c}" for c in f) + " FROM sp, sc"
        for label, a, b in (("standard", "c", "s"), ("robust", "m", "i")))
    gram = "SELECT scaling, count(*) AS n, avg(y) AS my, " + ", ".join(f"avg({c}) AS mu{i}" for i, c in enumerate(f)) + ", " + ", ".join(
        f"covar_pop({f[i]}, {f[j]}) * count(*) AS g{i}{j}" for i in range(p) for j in range(p)) + ", " + ", ".join(
        f"covar_pop({c}, y) * count(*) AS t{i}" for i, c in enumerate(f)) + " FROM scaled WHERE NOT is_test GROUP BY scaling"
    system = "SELECT scaling, model, no, my, " + ", ".join(f"mu{i}" for i in range(p)) + ", " + ", ".join(
        (f"g{i}{j}" + (" + alpha" if i == j else "") if j < p else f"t{i}") + f" AS a{i}{j}" for i in range(p) for j in range(p + 1)) + (
        " FROM g, (VALUES ('ols', 0.0, 0), ('ridge', 1.0, 1)) m(model, alpha, no)")
    solved = _solve_ctes("sys", p, "e")
    const = "my" + "".join(f" - x{i} * mu{i}" for i in range(p))
    return (_M21_SQL.rstrip() + f",\nok AS (SELECT * FROM m21 WHERE {where}),\n"
            "fe AS (SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM ok),\n"
            f"sc AS (SELECT {st} FROM ok),\n"
            "sp AS (SELECT ok.*, greatest(q1 - 1.5 * (q3 - q1), least(q3 + 1.5 * (q3 - q1), price)) AS y, "
            "row_number() OVER (ORDER BY md5(CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR) || '|42')) "
            "<= ceil(count(*) OVER () * 0.2 - 1e-9) AS is_test FROM ok, fe),\n"
            f"scaled AS ({scaled}),\ng AS ({gram}),\nsys AS ({system}),\n{solved},\n"
            f"sol AS (SELECT *, {const} AS b_const FROM ex0)\n")


_PRED = "(b_const + " + " + ".join(f"x{i} * {c}" for i, c in enumerate(GRID_FEATS)) + ")"
_SCORES = (f"SELECT model || '_' || sol.scaling AS model, round(avg((y - {_PRED}) ^ 2) / var_pop(y), 6) AS mse_share, "
           f"round(1 - avg((y - {_PRED}) ^ 2) / var_pop(y), 6) AS r2 FROM scaled JOIN sol ON sol.scaling = scaled.scaling "
           "WHERE is_test GROUP BY model, sol.scaling")


def _linear(fits):
    return [x for x in fits if not x[0].startswith("lasso")]


@query("m14_linear_grid_scores", _grid_ctes() + _SCORES)
def m14_linear_grid_scores(spark, sf_dir):
    """OLS and ridge on both scalings: test MSE as a share of the test variance, and R²."""
    rows = [(label, 1 - r2, r2) for label, _, _, (_, r2) in _linear(grid_fits(spark, sf_dir))]
    return rnd(spark.createDataFrame(rows, "model string, mse_share double, r2 double"), {"mse_share": 6, "r2": 6})


@query("o5_best_linear_model",
       _grid_ctes() + f"SELECT r2, count(*) AS models FROM ({_SCORES}) GROUP BY r2 ORDER BY r2 DESC LIMIT 1")
def o5_best_linear_model(spark, sf_dir):
    """The best rounded test R² of the linear models, and how many of them reach it."""
    t = m14_linear_grid_scores(spark, sf_dir).groupBy("r2").agg(F.count(F.lit(1)).alias("models"))
    return ST.best_by(t, "r2", "models")


@query("m13_linear_raw_units",
       _grid_ctes() + " UNION ALL ".join(
           f"SELECT model || '_{label}' AS model, '{c}' AS feature, round(x{i} / {b}_{c}, 4) AS coef FROM sol, sc WHERE scaling = '{label}'"
           for label, b in (("standard", "s"), ("robust", "i")) for i, c in enumerate(GRID_FEATS)))
def m13_linear_raw_units(spark, sf_dir):
    """Slopes of the linear models in the features' raw units."""
    rows = []
    for label, sc, f, _ in _linear(grid_fits(spark, sf_dir)):
        rows += [(label, c, float(v)) for c, v in zip(GRID_FEATS, M.raw_units(f, sc.center, sc.scale)[1])]
    return rnd(spark.createDataFrame(rows, "model string, feature string, coef double"), {"coef": 4})


# ---------------------------------------------------------------------------
# all six models, the lasso's by coordinate descent in a recursive query


def _lasso_ctes(alpha: float = 0.1) -> str:
    """``fits``: all six models' slopes and constants.  One recursion is one round over the weights."""
    p = len(GRID_FEATS)
    now, inner = [f"w{i}" for i in range(p)], "cd JOIN g USING (scaling)"
    for j in range(p):
        pull = f"(t{j} - (" + " + ".join(f"g{j}{i} * {now[i]}" for i in range(p) if i != j) + ")) / n"
        new = f"sign({pull}) * greatest(abs({pull}) - {alpha}, 0) / (g{j}{j} / n)"
        inner = f"(SELECT *, {new} AS u{j} FROM {inner})"
        now[j] = f"u{j}"
    change = " + ".join(f"abs(u{i} - w{i})" for i in range(p))
    step = f"SELECT scaling, k + 1, {', '.join(now)}, {change} FROM {inner} WHERE k < 3000 AND moved > 0"
    first = "SELECT scaling, 0, " + ", ".join("CAST(0 AS DOUBLE)" for _ in range(p)) + ", CAST(1 AS DOUBLE) FROM g"
    names = ", ".join(f"w{i}" for i in range(p))
    const = "my" + "".join(f" - w{i} * mu{i}" for i in range(p))
    cols = ", ".join(f"x{i}" for i in range(p))
    return (f",\ncd(scaling, k, {names}, moved) AS ({first} UNION ALL {step}),\n"
            f"las AS (SELECT scaling, 'lasso' AS model, 2 AS no, {', '.join(f'w{i} AS x{i}' for i in range(p))}, {const} AS b_const "
            "FROM (SELECT *, row_number() OVER (PARTITION BY scaling ORDER BY k DESC) AS r FROM cd) JOIN g USING (scaling) WHERE r = 1),\n"
            f"fits AS (SELECT scaling, model, no, {cols}, b_const FROM sol UNION ALL SELECT scaling, model, no, {cols}, b_const FROM las)\n")


_GRID6 = _grid_ctes().replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + _lasso_ctes()
_NO = "CAST(no + CASE WHEN fits.scaling = 'robust' THEN 3 ELSE 0 END AS INTEGER)"
_SCORES6 = (f"SELECT {_NO} AS model_no, model || '_' || fits.scaling AS model, round(avg((y - {_PRED}) ^ 2), -5) AS mse, "
            f"round(1 - avg((y - {_PRED}) ^ 2) / var_pop(y), 6) AS r2 FROM scaled JOIN fits ON fits.scaling = scaled.scaling "
            "WHERE is_test GROUP BY no, model, fits.scaling")


@query("m14_model_grid_scores", _GRID6 + _SCORES6)
def m14_model_grid_scores(spark, sf_dir):
    """Six models (OLS, ridge α=1, lasso α=0.1 × standard/robust scaling) scored on the
    test rows: MSE to about seven digits, R²."""
    rows = [(i, label, *score) for i, (label, _, _, score) in enumerate(grid_fits(spark, sf_dir))]
    return rnd(spark.createDataFrame(rows, "model_no int, model string, mse double, r2 double"), {"mse": -5, "r2": 6})


@query("o5_best_model", _GRID6 + f"SELECT * FROM ({_SCORES6}) ORDER BY r2 DESC, model_no LIMIT 1")
def o5_best_model(spark, sf_dir):
    """The best R² to six digits, the first model of those that reach it."""
    return ST.best_by(m14_model_grid_scores(spark, sf_dir), "r2", "model_no")


def _raw_units_sql() -> str:
    parts = []
    for label, a, b in (("standard", "c", "s"), ("robust", "m", "i")):
        const = "b_const" + "".join(f" - x{i} * {a}_{c} / {b}_{c}" for i, c in enumerate(GRID_FEATS))
        where = f"FROM fits, sc WHERE scaling = '{label}'"
        parts.append(f"SELECT {_NO} AS model_no, 'const' AS feature, round({const}, 2) AS coef {where}")
        parts += [f"SELECT {_NO} AS model_no, '{c}' AS feature, round(x{i} / {b}_{c}, 4) AS coef {where}" for i, c in enumerate(GRID_FEATS)]
    return _GRID6 + " UNION ALL ".join(parts)


@query("m13_raw_unit_coefficients", _raw_units_sql())
def m13_raw_unit_coefficients(spark, sf_dir):
    """Each grid model's coefficients expressed back in the features' raw units."""
    rows = []
    for i, (_, sc, f, _) in enumerate(grid_fits(spark, sf_dir)):
        b0, coef = M.raw_units(f, sc.center, sc.scale)
        rows.append((i, "const", round(float(b0), 2)))
        rows += [(i, c, round(float(v), 4)) for c, v in zip(GRID_FEATS, coef)]
    return spark.createDataFrame(rows, "model_no int, feature string, coef double")


_LASSO_ITEMS = f"""WITH RECURSIVE it AS (SELECT CAST(l_quantity AS DOUBLE) AS a, CAST(l_discount AS DOUBLE) AS b, CAST(l_tax AS DOUBLE) AS c,
CAST(l_linenumber AS DOUBLE) AS d, CAST({Q.cents('l_extendedprice')} AS DOUBLE) / 1e6 AS y FROM lineitem),
g AS (SELECT 'all' AS scaling, count(*) AS n, avg(y) AS my, """ + ", ".join(f"avg({c}) AS mu{i}" for i, c in enumerate("abcd")) + ", " + ", ".join(
    f"covar_pop({x}, {z}) * count(*) AS g{i}{j}" for i, x in enumerate("abcd") for j, z in enumerate("abcd")) + ", " + ", ".join(
    f"covar_pop({x}, y) * count(*) AS t{i}" for i, x in enumerate("abcd")) + """ FROM it),
sol AS (SELECT scaling, '' AS model, 0 AS no, my AS x0, my AS x1, my AS x2, my AS x3, my AS b_const FROM g WHERE false)"""


@query("m7_lasso_weights", _LASSO_ITEMS + _lasso_ctes(0.0005) + "SELECT 'const' AS feature, round(b_const, 8) AS coef FROM fits"
       + "".join(f" UNION ALL SELECT '{c}', round(x{i}, 8) FROM fits" for i, c in enumerate("abcd")))
def m7_lasso_weights(spark, sf_dir):
    """A penalty that leaves out some of the features."""
    li = TB.table(spark, sf_dir, "lineitem").select(
        F.col("l_quantity").cast("double").alias("a"), F.col("l_discount").cast("double").alias("b"), F.col("l_tax").cast("double").alias("c"),
        F.col("l_linenumber").cast("double").alias("d"), (TB.cents("l_extendedprice").cast("double") / 1e6).alias("y"))
    return rnd(M.lasso(li, list("abcd"), "y", 0.0005).coef_df(spark), {"coef": 8})


# ---------------------------------------------------------------------------
# the panel study on three variants of the same data


def _study_ctes(src: str, tag: str) -> dict:
    return {f"sp{tag}": Q.split_sql(src), f"tr{tag}": f"SELECT * FROM sp{tag} WHERE NOT is_test",
            f"g{tag}": Q.gram3_sql(f"tr{tag}", X3, "price"), f"iv{tag}": Q.inv3_sql(f"g{tag}"), f"co{tag}": Q.ols3_coef_sql(f"iv{tag}")}


def _variants():
    pred = "(b_const + b0 * CNY_JPY + b1 * PHP_JPY + b2 * VND_JPY)"
    ctes = dict(Q.panel_ctes(), v0="SELECT * FROM panel", v1=Q.standard_sql("panel", COLS4), pc=Q.pct_sql("panel", COLS4),
                v2="SELECT * FROM pc WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in COLS4))
    parts = []
    for k, name in enumerate(("levels", "standardised", "pct_change")):
        ctes |= _study_ctes(f"v{k}", str(k))
        parts.append(f"SELECT '{name}' AS variant, count(*) AS n_test, round(avg((price - {pred}) ^ 2) / var_pop(price), 6) AS mse_share, "
                     f"round(1 - avg((price - {pred}) ^ 2) / var_pop(price), 6) AS r2 FROM sp{k}, co{k} WHERE is_test")
    return Q.cte(**ctes) + "\nUNION ALL\n".join(parts)


@query("m21_three_variant_study", _variants())
def m21_three_variant_study(spark, sf_dir):
    """One regression study applied to levels, standardised columns and percentage changes."""
    rows = []
    for name, d in (("levels", panel(spark, sf_dir)), ("standardised", std_panel(spark, sf_dir)), ("pct_change", pct_panel(spark, sf_dir))):
        g = M.gram_by(M.train_test_split(d, ["Date"], 0.2, 42), X3, "price", "is_test")
        _, r2 = M.gram_scores(M.ols(None, X3, "price", g[False]), g[True])
        rows.append((name, g[True].n, 1 - r2, r2))
    return rnd(spark.createDataFrame(rows, "variant string, n_test long, mse_share double, r2 double"), {"mse_share": 6, "r2": 6})


_RESIDUALS = (Q.cte(**Q.panel_ctes(), mm=Q.minmax_sql("panel", COLS4), **_study_ctes("mm", "0")).rstrip()
              + ",\nre AS (SELECT Date, is_test, price - (b_const + b0 * CNY_JPY + b1 * PHP_JPY + b2 * VND_JPY) AS e FROM sp0, co0)\n")


def _residuals(spark, sf_dir):
    s = mm_split(spark, sf_dir)
    fit = M.ols(s.where(~F.col("is_test")), X3, "price")
    return fit.predict(s, "y_pred").select("Date", "is_test", (F.col("price") - F.col("y_pred")).alias("e"))


@query("w7_qq_test_residuals",
       _RESIDUALS + "SELECT Date, CAST(row_number() OVER (ORDER BY e, Date) AS BIGINT) AS i, "
       "round((e - avg(e) OVER ()) / stddev_pop(e) OVER (), 6) AS sample FROM re WHERE is_test")
def w7_qq_test_residuals(spark, sf_dir):
    """Q-Q order and standardised sample values of the test rows' residuals."""
    e = _residuals(spark, sf_dir).where("is_test")
    return rnd(M.qq_pairs(e, "e", "Date", buckets=1).select("Date", F.col("i").cast("long").alias("i"), "sample"), {"sample": 6})


@query("a15_histogram_residuals",
       _RESIDUALS.rstrip() + """,
st AS (SELECT count(*) AS n, min(e) AS lo, max(e) AS hi, quantile_cont(e, 0.25) AS q1, quantile_cont(e, 0.75) AS q3 FROM re),
nb AS (SELECT *, CAST(ceil((hi - lo) / least(2.0 * (q3 - q1) * pow(n, -1.0 / 3.0), (hi - lo) / (log2(n) + 1.0))) AS INTEGER) AS bins FROM st)
SELECT CAST(least(bins - 1, floor((e - lo) * bins / (hi - lo))) AS BIGINT) AS bin, CAST(bins AS BIGINT) AS n_bins, count(*) AS count
FROM re, nb GROUP BY 1, 2""")
def a15_histogram_residuals(spark, sf_dir):
    """Histogram of the residuals of all rows."""
    return ST.histogram(_residuals(spark, sf_dir), "e").select("bin", "n_bins", "count")


@query("m17_band_shape",
       Q.cte(**Q.panel_ctes(), mm=Q.minmax_sql("panel", COLS4),
             st="SELECT regr_count(price, CNY_JPY) AS n, regr_avgx(price, CNY_JPY) AS mx, regr_sxx(price, CNY_JPY) AS sxx, "
                "regr_slope(price, CNY_JPY) AS b, regr_intercept(price, CNY_JPY) AS a, min(CNY_JPY) AS lo, max(CNY_JPY) AS hi FROM mm",
             gr="SELECT st.*, CAST(i AS INTEGER) AS i, lo + i * ((hi - lo) / 99) AS x FROM st, range(100) t(i)")
       + "SELECT i, round(x, 6) AS x, round(a + b * x, 6) AS y_hat, "
       "round(sqrt(1.0 / n + (x - mx) ^ 2 / sxx) / sqrt(1.0 / n + (lo - mx) ^ 2 / sxx), 6) AS width FROM gr")
def m17_band_shape(spark, sf_dir):
    """The fitted line, and the band's half width relative to its first point (the t quantile, which
    SQL has no built-in for, cancels)."""
    band = M.reg_band(mm_panel(spark, sf_dir), "CNY_JPY", "price")
    first = band.orderBy("x").first()
    width = (F.col("hi") - F.col("lo")) / F.lit(first["hi"] - first["lo"])
    # one row per grid point
    i = (F.row_number().over(Window.orderBy("x")) - 1).cast("int")
    return rnd(band.select(i.alias("i"), "x", "y_hat", width.alias("width")), {"x": 6, "y_hat": 6, "width": 6})


# ---------------------------------------------------------------------------
# shared axes and small operators


@query("m21_two_trends_one_axis",
       Q.cte(daily=Q.DAILY, rates=Q.RATES, lo="SELECT min(Date) AS d0 FROM (SELECT Date FROM daily UNION ALL SELECT Date FROM rates)")
       + " UNION ALL ".join(
           f"SELECT '{n}' AS series, count(*) AS n, round(regr_slope({c}, date_diff('day', d0, Date)), 6) AS slope, "
           f"round(regr_intercept({c}, date_diff('day', d0, Date)), 4) AS intercept FROM {t}, lo WHERE {c} IS NOT NULL"
           for n, c, t in (("price", "price", "daily"), ("CNY_JPY", "CNY_JPY", "rates"))))
def m21_two_trends_one_axis(spark, sf_dir):
    """Two series fitted on days from the earliest date of both."""
    series = {"price": TB.daily_price(spark, sf_dir), "CNY_JPY": TB.rates_wide_one_scan(spark, sf_dir)}
    first = ST.min_across(list(series.values()), "Date").first()[0]
    out = None
    for name, d in series.items():
        x = d.where(F.col(name).isNotNull()).select(F.lit(name).alias("series"), F.datediff("Date", F.lit(first)).cast("double").alias("x"),
                                                    F.col(name).alias("y"))
        out = x if out is None else out.unionByName(x)
    fit = ST.linregress(out, "x", "y", by=["series"]).select("series", "n", "slope", "intercept")
    return rnd(fit, {"slope": 6, "intercept": 4})


@query("m21_survey_trend",
       f"WITH s AS ({_SURVEY_SQL}), o AS (SELECT price_mean, row_number() OVER (ORDER BY year * 100 + month) - 1 AS i FROM s) "
       "SELECT count(*) AS n, round(regr_slope(price_mean, i), 6) AS slope, round(regr_intercept(price_mean, i), 4) AS intercept FROM o")
def m21_survey_trend(spark, sf_dir):
    """Survey folder, months in order, then a straight line through the monthly means."""
    rows, _ = _survey_rows(spark, sf_dir)
    monthly = rows.groupBy("year", "month").agg((F.sum("price_sum") / F.sum("n_prices")).alias("y"))
    # one row per calendar month
    i = F.row_number().over(Window.orderBy(F.col("year") * 100 + F.col("month"))) - 1
    fit = ST.linregress(monthly.select(i.cast("double").alias("x"), "y"), "x", "y").select("n", "slope", "intercept")
    return rnd(fit, {"slope": 6, "intercept": 4})


@query("p13_lookup_default_zero",
       Q.cte(daily=Q.DAILY, side2=_SIDE2_SQL, sf=_SIDE_FIRST_SQL)
       + "SELECT Date, coalesce(sf.Gasoline, 0) AS Gasoline FROM daily LEFT JOIN sf ON sf.year = year(daily.Date) "
       "AND sf.month = month(daily.Date) AND sf.month <> 2")
def p13_lookup_default_zero(spark, sf_dir):
    """A month without a value (here every February) is looked up as 0."""
    d = TB.daily_price(spark, sf_dir).select("Date", F.year("Date").alias("year"), F.month("Date").alias("month"))
    side = side_two_files(spark, sf_dir).where("month <> 2")
    return AL.first_match(d, side, ["year", "month"], ["Gasoline"], order="file", default=0.0).select("Date", "Gasoline")


@query("p8_rates_filled_with_zero",
       Q.cte(rates=Q.RATES) + "SELECT Date, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in X3) + " FROM rates")
def p8_rates_filled_with_zero(spark, sf_dir):
    """Days without a value of a series hold 0."""
    return CL.fill_zero(TB.rates_wide_one_scan(spark, sf_dir), X3)


@query("s3_projected_scan",
       "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderpriority FROM orders")
def s3_projected_scan(spark, sf_dir):
    """Columns taken by name and by position from a header CSV."""
    path = scratch_path(spark, "projected")
    TB.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority") \
        .write.option("header", True).csv(path)
    return delimited.read_csv_strings(spark, path, columns=["o_orderkey", 2])


@query("s1_quoted_line_ends",
       "SELECT page_id, url || chr(10) || 'and, ' || url AS note FROM pages")
def s1_quoted_line_ends(spark, sf_dir):
    """Quoted fields that hold a comma and a line end come back whole."""
    path = scratch_path(spark, "quoted")
    p = TB.table(spark, sf_dir, "pages").select("page_id", F.concat("url", F.lit("\n"), F.lit("and, "), "url").alias("note"))
    p.write.option("header", True).option("quoteAll", True).csv(path)
    return delimited.read_csv_strings(spark, path).select(F.col("page_id").cast("long").alias("page_id"), "note")


@query("f20_sheet_names", "SELECT page_id, translate(url, '/' || chr(92), '__') AS sheet FROM pages")
def f20_sheet_names(spark, sf_dir):
    return TB.table(spark, sf_dir, "pages").select("page_id", TX.safe_sheet_name("url").alias("sheet"))


@query("a18_tally_with_errors",
       "SELECT CASE WHEN month(o_orderdate) % 4 = 0 THEN 'error' ELSE 'ok' END AS status, "
       f"count(DISTINCT year(o_orderdate) * 100 + month(o_orderdate)) AS files FROM orders "
       f"WHERE o_orderpriority = '{TB.SIDE_PRIORITY}' GROUP BY 1")
def a18_tally_with_errors(spark, sf_dir):
    """Months whose date cell was lost count as errors."""
    rows, _ = _survey_rows(spark, sf_dir)
    files = rows.groupBy("year", "month").agg(F.count(F.lit(1)).alias("parts"))
    return surveys.ingest_tally(files.withColumn("year", F.when(F.col("month") % 4 != 0, F.col("year"))))



# ---------------------------------------------------------------------------
# schedule pages

_PAGES_SQL = """WITH b AS (
    SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS blk, (l_orderkey + l_linenumber) % 5 <> 0 AS dated,
           CASE WHEN (l_orderkey * 3 + l_linenumber) % 29 <> 0 THEN month(l_shipdate) END AS mi,
           CASE WHEN (l_orderkey + l_linenumber) % 5 = 0 THEN 0 WHEN l_orderkey % 23 = 0 AND l_linenumber = 2 THEN NULL
                ELSE (l_orderkey * 7 + l_linenumber) % 9 - 1 END AS wk,
           (l_orderkey + 2 * l_linenumber) % 31 = 0 AS nameless, l_orderkey % 19 <> 0 AS keyed,
           'part ' || l_partkey AS name, CAST(l_quantity AS BIGINT) AS q, l_linenumber % 3 = 0 AS again FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey,
           min(l_quantity) AS l_quantity, min(l_shipdate) AS l_shipdate FROM lineitem GROUP BY 1, 2)),
g AS (SELECT *, nameless OR (dated AND mi IS NULL) OR wk IS NULL OR wk NOT BETWEEN -3 AND 6 AS fails FROM b),
f AS (SELECT page, min(blk) FILTER (WHERE fails) AS f FROM g GROUP BY page),
c AS (SELECT g.*, f.f FROM g JOIN f ON f.page = g.page WHERE f.f IS NULL OR blk <= f.f),
m AS (SELECT *, last_value(CASE WHEN dated THEN mi END IGNORE NULLS) OVER (ORDER BY page, blk ROWS UNBOUNDED PRECEDING) AS mon FROM c),
pm AS (SELECT page, arg_max(mon, blk) AS month FROM m GROUP BY page)
SELECT m.page AS page_id, CAST(m.page AS VARCHAR) AS ym, CAST(((wk - 2) % 5 + 5) % 5 + 1 AS INTEGER) AS slot, CAST(pm.month AS INTEGER) AS month,
       CAST(blk AS INTEGER) AS block_no, 0 AS item_no, name, CAST(q AS VARCHAR) AS price, 'c' AS category, again AS is_resell
FROM m JOIN pm ON pm.page = m.page WHERE f IS NULL AND pm.month IS NOT NULL AND keyed
QUALIFY blk = max(blk) OVER (PARTITION BY m.page, ((wk - 2) % 5 + 5) % 5)"""


def _schedule_pages(spark, sf_dir):
    """One schedule page per order (one item per line number, seven at most), some broken in each
    way a page can be."""
    # dealt by page before there is any text, in a number of parts that doesn't go by the bytes of these few numbers
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = ["l_partkey", "l_quantity", "l_shipdate"]
    li = TB.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *own).repartition(parts, "l_orderkey") \
        .groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in own])
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    span = lambda x: F.concat(F.lit('<span class="pg-schedule__month--date">'), x, F.lit("</span>"))
    month = F.when((k * 3 + n) % 29 != 0, F.month("l_shipdate").cast("string")).otherwise(F.lit("x"))
    week = F.when((k % 23 == 0) & (n == 2), F.lit("")).otherwise(span(((k * 7 + n) % 9 - 1).cast("string")))
    dates = F.when((k + n) % 5 != 0, F.concat(span(month), week)).otherwise(F.lit(""))
    name = F.when((k + 2 * n) % 31 != 0, F.concat(F.lit('<p class="c-card__name">part '), F.col("l_partkey").cast("string"), F.lit("</p>"))) \
        .otherwise(F.lit(""))
    again = F.when(n % 3 == 0, F.lit(f'<span class="c-card__resale--txt">{TX.RESTOCK_TEXT}</span>')).otherwise(F.lit(""))
    block = F.concat(F.lit('<div class="week">'), dates, F.lit('<div class="c-card__list">'), name,
                     F.lit('<span class="c-card__price--main">'), F.col("l_quantity").cast("long").cast("string"),
                     F.lit('</span><i class="c-card__category">c</i>'), again, F.lit("</div></div>"))
    pages = li.select(k.alias("page_id"), F.struct(n.alias("n"), block.alias("b")).alias("s")) \
        .groupBy("page_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["b"]), "").alias("html"))
    url = F.when(F.col("page_id") % 19 != 0, F.concat(F.lit("u?ym="), F.col("page_id").cast("string"))).otherwise(F.lit("u"))
    return pages.withColumn("url", url)


@query("s11w5w6_schedule_pages", _PAGES_SQL)
def s11w5w6_schedule_pages(spark, sf_dir):
    """Schedule pages to items: blocks and items from the page, week slots, month carry, lost pages."""
    blocks = html.extract_blocks(_schedule_pages(spark, sf_dir), "html", ["page_id", "url"], html.SCHEDULE_SPEC)
    return html.schedule_items(blocks, "page_id")
