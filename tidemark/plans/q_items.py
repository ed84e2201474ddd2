"""Whole studies: the item grid end to end, a raw multiple regression of the items, the panel's three variants.

The item studies take their sections from what ``items.prepare`` gathers: the quantiles (fences, robust scaling,
descriptions) and the moments of the clipped rows by split flag (correlations, VIF, scalings, all fits, scores, lines).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import align as AL
from ..operators import models as M
from ..operators import scale as SC
from ..operators import stats as ST
from ..session import cut_lineage
from . import sqlkit as Q
from . import sqlstudy as QS
from . import tables as TB
from .catalog import panel, query, rnd
from .items import GRID_FEATS, KEY, ItemStudy, grid, prepare, scalings
from .q_more import _GRID6, _solve_ctes
from .q_study import X3
from .studies import _SCHEMA, regression_sections

def _corr_rows(g: M.Gram) -> list[tuple]:
    names = [*g.xs, g.y]
    full = np.block([[g.Sxx, g.Sxy[:, None]], [g.Sxy[None, :], np.array([[g.Syy]])]])
    _, r = M.to_corr(full)
    return [("correlation", a, b, float(r[i, j]), None) for i, a in enumerate(names) for j, b in enumerate(names)]


def grid_study(spark, sf_dir) -> DataFrame:
    """Fences, correlations, uncentred VIF, descriptions of both scalings, the grid, the best model, and the OLS summary of all
    rows with features' coefficients in raw units (R², t and p don't depend on the scaling)."""
    s = prepare(spark, sf_dir)
    every, rows = s.every, []
    n_out = s.rows.where((F.col("price") <= s.lower) | (F.col("price") >= s.upper)).count()
    rows += [("fences", "price", k, float(v), None) for k, v in (
        ("lower", s.lower), ("upper", s.upper), ("n_outside", n_out), ("n", every.n), ("outside_pct", 100.0 * n_out / every.n))]
    rows += _corr_rows(every)
    rows += [("vif", c, "vif", float(v), None) for c, v in M.vif(None, GRID_FEATS, constant=False, g=every)]
    for label, sc in scalings(s):
        g = M.rescaled(every, sc.center, sc.scale)
        for i, c in enumerate(GRID_FEATS):
            moved = lambda k: (s.quartiles[c][k] - sc.center[c]) / sc.scale[c]
            figures = {"count": g.n, "mean": g.xbar[i], "std": np.sqrt(g.Sxx[i, i] / (g.n - 1)), "min": moved("q0"), "q25": moved("q25"),
                       "q50": moved("q50"), "q75": moved("q75"), "max": moved("q100")}
            rows += [(f"describe_{label}", c, k, float(v), None) for k, v in figures.items()]
    models = grid(s)
    for label, sc, fit, mse, r2 in models:
        const, coef = M.raw_units(fit, sc.center, sc.scale)
        rows += [("grid", label, "mse_share", 1 - r2, None), ("grid", label, "r2", r2, None), ("grid", label, "const", const / 1e6, None)]
        rows += [("grid", label, c, float(v) / 1e3, None) for c, v in zip(GRID_FEATS, coef)]
    best = max(models, key=lambda m: (round(m[4], 6), -models.index(m)))
    rows.append(("best", best[0], "r2", best[4], best[0]))
    fit = M.ols(None, GRID_FEATS, "price", every)
    summary = M.ols_summary(s.rows, GRID_FEATS, "price", order=[*KEY, "price", *GRID_FEATS], fit=fit)
    keep = ["n", "df_model", "df_resid", "r2", "adj_r2", "f_stat", "f_pvalue", "omnibus", "omnibus_p", "skew", "kurtosis", "durbin_watson",
            "jarque_bera", "jb_p"]
    rows += [("ols_summary", k, "value", float(summary.stats[k]), None) for k in keep]
    # what grows with n · price² is given for one row
    rows += [("ols_summary", k, "per_row", float(summary.stats[k]) / every.n, None) for k in ("log_likelihood", "aic", "bic")]
    for term, coef, se, t, p, lo, hi in summary.table[1:]:
        rows += [("ols_coefficients", term, k, float(v), None) for k, v in (
            ("coef", coef / 1e3), ("std_err", se / 1e3), ("t", t), ("p_value", p), ("ci_low", lo / 1e3), ("ci_high", hi / 1e3))]
    return spark.createDataFrame(rows, _SCHEMA)


# ---------------------------------------------------------------------------
# SQL of the item studies


def _all_ctes() -> str:
    """After the grid's CTEs: moments of all rows, their solution, each feature's inverse diagonal, residual moments."""
    f, p = GRID_FEATS, len(GRID_FEATS)
    out = ["al AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(y) AS my, var_pop(y) * count(*) AS syy, " + ", ".join(f"avg({c}) AS mu{i}" for i, c in enumerate(f)) + ", "
           + ", ".join(f"covar_pop({f[i]}, {f[j]}) * count(*) AS a{i}{j}" for i in range(p) for j in range(p)) + ", "
           + ", ".join(f"covar_pop({c}, y) * count(*) AS a{i}{p}" for i, c in enumerate(f)) + " FROM sp)",
           _solve_ctes("al", p, "q"),
           "one AS (SELECT *, my - (" + " + ".join(f"x{i} * mu{i}" for i in range(p)) + ") AS b_const FROM qx0)",
           "rs AS (SELECT l_orderkey, l_linenumber, y, " + ", ".join(f) + ", y - (b_const + " + " + ".join(f"x{i} * sp.{c}" for i, c in enumerate(f)) + ") AS e FROM sp, one)",
           "rm AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(e * e) AS sse, avg(e) AS me FROM rs)",
           "rc AS (SELECT n, sse, sum((e - me) ^ 2) / n AS c2, sum((e - me) ^ 3) / n AS c3, sum((e - me) ^ 4) / n AS c4 FROM rs, rm GROUP BY n, sse)",
           "rd AS (SELECT sum((e - pe) ^ 2) AS ssd FROM (SELECT e, lag(e) OVER (ORDER BY l_orderkey, l_linenumber, y, " + ", ".join(f) + ") AS pe FROM rs))",
           "st AS (SELECT rc.n AS n, sse, 1 - sse / al.syy AS r2, c3 / c2 ^ 1.5 AS skew, c4 / (c2 * c2) AS kurt, ssd / sse AS dw FROM rc, rd, al)"]
    z = QS.study_ctes({}, "x")
    out += [f"{k} AS ({z[k]})" for k in ("z", "z2", "om")]
    for j in range(p):
        o = [k for k in range(p) if k != j]
        sel = ", ".join([f"a{j}{j} / n AS q", "n"] + [f"a{o[a]}{o[b]} / n AS s{a}{b}" for a in range(3) for b in range(a, 3)] + [f"a{o[a]}{j} / n AS t{a}" for a in range(3)])
        out.append(f"iu{j} AS (SELECT {sel} FROM al)")
        out.append(f"iv{j} AS ({Q.inv3_sql(f'iu{j}')})")
        quad = " + ".join(f"t{a} * {QS._INV[a, b]} * t{b}" for a in range(3) for b in range(3))
        out.append(f"id{j} AS (SELECT 1 / (n * (q - ({quad}))) AS d FROM iv{j})")
    tq = {"tq0": "SELECT n - 5.0 AS v, CAST(1.96 AS DOUBLE) AS t FROM st"} | {k: v for k, v in QS._quantile_ctes().items() if k != "tq0"}
    out += [f"{k} AS ({v})" for k, v in tq.items()]
    out.append("tb AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS term, x{j} AS coef, sqrt(sse / (st.n - 5) * d) AS std_err, st.n - 5.0 AS v FROM one, st, id{j}" for j, c in enumerate(f)) + ")")
    return ",\n".join(out)


def _grid_study_sql() -> str:
    f, p = GRID_FEATS, len(GRID_FEATS)
    row = QS._row
    base = _GRID6.rstrip() + ",\n" + _all_ctes() + "\n"
    lower, upper = "q1 - 1.5 * (q3 - q1)", "q3 + 1.5 * (q3 - q1)"
    out = f"count(*) FILTER (WHERE price <= {lower} OR price >= {upper})"
    parts = [row("fences", "'price'", k, e, "ok, fe GROUP BY q1, q3") for k, e in (
        ("lower", lower), ("upper", upper), ("n_outside", out), ("n", "count(*)"), ("outside_pct", f"100.0 * {out} / count(*)"))]
    names = [(c, c) for c in f] + [("price", "y")]
    parts += [row("correlation", f"'{a}'", b, f"corr({x}, {y})", "sp") for a, x in names for b, y in names]
    # uncentred: the inverse diagonal of the cross products
    for j, c in enumerate(f):
        o = [k for k in f if k != c]
        u = ("(SELECT avg({0} * {0}) AS q, 1 AS n, ".format(c) + ", ".join(f"avg({o[a]} * {o[b]}) AS s{a}{b}" for a in range(3) for b in range(a, 3)) + ", "
             + ", ".join(f"avg({o[a]} * {c}) AS t{a}" for a in range(3)) + " FROM sp)")
        quad = " + ".join(f"t{a} * {QS._INV[a, b]} * t{b}" for a in range(3) for b in range(3))
        parts.append(row("vif", f"'{c}'", "vif", f"q / (q - ({quad}))", f"({Q.inv3_sql(u)})"))
    for label, a, b in (("standard", "c", "s"), ("robust", "m", "i")):
        for c in f:
            v = f"(({c} - {a}_{c}) / {b}_{c})"
            figures = {"count": f"count({v})", "mean": f"avg({v})", "std": f"stddev_samp({v})", "min": f"min({v})", "q25": f"quantile_cont({v}, 0.25)",
                       "q50": f"quantile_cont({v}, 0.5)", "q75": f"quantile_cont({v}, 0.75)", "max": f"max({v})"}
            parts += [row(f"describe_{label}", f"'{c}'", k, e, "sp, sc") for k, e in figures.items()]
    name = "model || '_' || fits.scaling"
    pred = "(b_const + " + " + ".join(f"x{i} * {c}" for i, c in enumerate(f)) + ")"
    share = f"avg((y - {pred}) ^ 2) / var_pop(y)"
    scored = "scaled JOIN fits ON fits.scaling = scaled.scaling WHERE is_test GROUP BY model, fits.scaling"
    parts += [row("grid", name, "mse_share", share, scored), row("grid", name, "r2", f"1 - {share}", scored)]
    for label, a, b in (("standard", "c", "s"), ("robust", "m", "i")):
        where = f"fits, sc WHERE scaling = '{label}'"
        const = "b_const" + "".join(f" - x{i} * {a}_{c} / {b}_{c}" for i, c in enumerate(f))
        parts.append(row("grid", name, "const", f"({const}) / 1e6", where))
        parts += [row("grid", name, c, f"x{i} / {b}_{c} / 1e3", where) for i, c in enumerate(f)]
    best = (f"(SELECT {name} AS name, 1 - {share} AS r2, no + CASE WHEN fits.scaling = 'robust' THEN 3 ELSE 0 END AS k FROM scaled "
            "JOIN fits ON fits.scaling = scaled.scaling WHERE is_test GROUP BY no, model, fits.scaling ORDER BY round(r2, 6) DESC, k LIMIT 1)")
    parts.append(f"SELECT 'best' AS section, name AS row_name, 'r2' AS col_name, round(r2, 6) AS value, name AS text FROM {best}")
    f_stat = "(r2 / 4) / ((1 - r2) / (n - 5))"
    llf = "(-n / 2.0 * (ln(2 * pi()) + ln(sse / n) + 1))"
    stats = {"n": "n", "df_model": "4", "df_resid": "n - 5", "r2": "r2", "adj_r2": "1 - (1 - r2) * (n - 1) / (n - 5)", "f_stat": f_stat,
             "f_pvalue": QS.f_tail("4", "n - 5", f_stat), "omnibus": "k2", "omnibus_p": "exp(-k2 / 2)", "skew": "skew", "kurtosis": "kurt",
             "durbin_watson": "dw", "jarque_bera": QS._STATS["jarque_bera"], "jb_p": QS._STATS["jb_p"]}
    parts += [row("ols_summary", f"'{k}'", "value", e, "st, om") for k, e in stats.items()]
    parts += [row("ols_summary", f"'{k}'", "per_row", f"({e}) / n", "st") for k, e in (
        ("log_likelihood", llf), ("aic", f"-2 * {llf} + 10"), ("bic", f"-2 * {llf} + 5 * ln(n)"))]
    parts += [row("ols_coefficients", "term", k, e, "tb, tq") for k, e in (
        ("coef", "coef / 1e3"), ("std_err", "std_err / 1e3"), ("t", "coef / std_err"), ("p_value", QS.two_sided("coef / std_err", "v")),
        ("ci_low", "(coef - tq.t * std_err) / 1e3"), ("ci_high", "(coef + tq.t * std_err) / 1e3"))]
    return base + "\nUNION ALL\n".join(f"SELECT * FROM ({x})" for x in parts)


@query("m21_grid_study", _grid_study_sql())
def m21_grid_study(spark, sf_dir):
    return grid_study(spark, sf_dir).withColumn("value", F.round("value", 6) + 0.0)


# ---------------------------------------------------------------------------
# the raw multiple regression of the clipped items


def _raw_fit_sql() -> str:
    """``sol`` of OLS on the raw features of the train rows, as ``raw`` (x0.., b_const)."""
    f, p = GRID_FEATS, len(GRID_FEATS)
    g = ("SELECT avg(y) AS my, " + ", ".join(f"avg({c}) AS mu{i}" for i, c in enumerate(f)) + ", "
         + ", ".join(f"covar_pop({f[i]}, {f[j]}) AS a{i}{j}" for i in range(p) for j in range(p)) + ", "
         + ", ".join(f"covar_pop({c}, y) AS a{i}{p}" for i, c in enumerate(f)) + " FROM sp WHERE NOT is_test")
    return (_GRID6.rstrip() + f",\ntg AS ({g}),\n" + _solve_ctes("tg", p, "r") + ",\nraw AS (SELECT *, my - ("
            + " + ".join(f"x{i} * mu{i}" for i in range(p)) + ") AS b_const FROM rx0)\n")


_RAW = _raw_fit_sql()
_RAW_PRED = "(b_const + " + " + ".join(f"x{i} * sp.{c}" for i, c in enumerate(GRID_FEATS)) + ")"


def _raw_fit(s: ItemStudy) -> M.LinearFit:
    return M.ols(None, GRID_FEATS, "price", s.train)


@query("m21_items_regression", _RAW + "\nUNION ALL\n".join(
    [f"SELECT 'r2' AS name, round(1 - avg((y - {_RAW_PRED}) ^ 2) / var_pop(y), 6) AS value FROM sp, raw WHERE is_test",
     f"SELECT 'mse_share', round(avg((y - {_RAW_PRED}) ^ 2) / var_pop(y), 6) FROM sp, raw WHERE is_test", "SELECT 'const', round(b_const / 1e6, 6) FROM raw"]
    + [f"SELECT '{c}', round(x{i} / 1e3, 6) FROM raw" for i, c in enumerate(GRID_FEATS)]))
def m21_items_regression(spark, sf_dir):
    """Test scores and coefficients of the raw features (in thousands; the constant in millions)."""
    s = prepare(spark, sf_dir)
    fit = _raw_fit(s)
    _, r2 = M.gram_scores(fit, s.test)
    rows = [("r2", r2), ("mse_share", 1 - r2), ("const", fit.intercept / 1e6)] + [(c, float(v) / 1e3) for c, v in zip(GRID_FEATS, fit.coef)]
    return rnd(spark.createDataFrame(rows, "name string, value double"), {"value": 6})


def _test_residuals(spark, sf_dir):
    s = prepare(spark, sf_dir)
    return _raw_fit(s).predict(s.rows.where("is_test"), "y_pred").select("y_pred", (F.col("price") - F.col("y_pred")).alias("residual"))


_RES = _RAW.rstrip() + f",\nrs AS (SELECT y - {_RAW_PRED} AS e FROM sp, raw WHERE is_test)\n"


@query("a15_histogram_item_residuals",
       _RES.rstrip() + ",\ns AS (SELECT min(e) AS lo, max(e) AS hi FROM rs)\nSELECT CAST(least(39, floor((e - lo) * 40 / (hi - lo))) AS BIGINT) AS bin, "
       "count(*) AS count FROM rs, s GROUP BY 1")
def a15_histogram_item_residuals(spark, sf_dir):
    return ST.histogram(_test_residuals(spark, sf_dir), "residual", bins=40).select("bin", "count")


@query("a16_kde_item_residuals",
       _RES.rstrip() + ",\ns AS (SELECT count(e) AS n, stddev_samp(e) * pow(count(e), -1.0 / 5.0) AS h, min(e) AS lo, max(e) AS hi FROM rs),\n"
       "gd AS (SELECT CAST(i AS INTEGER) AS i, lo + i * ((hi - lo) / 99) AS gx FROM s, range(100) t(i))\n"
       "SELECT gd.i, round(gx / 1e3, 3) AS x, round(1e9 * sum(exp(-0.5 * ((gx - e) / h) * ((gx - e) / h))) / (n * h * sqrt(2 * pi())), 5) AS density "
       "FROM gd, rs, s GROUP BY gd.i, gx, n, h")
def a16_kde_item_residuals(spark, sf_dir):
    """The density curve drawn over the histogram of the test rows' residuals."""
    k = ST.kde_grid(_test_residuals(spark, sf_dir), "residual", grid_size=100)
    return k.select("i", F.round(F.col("x") / 1e3, 3).alias("x"), F.round(F.col("density") * 1e9, 5).alias("density"))


def _surface_top_two_sql(k: int = 20) -> str:
    f = GRID_FEATS
    first = ", ".join(f"abs(corr({c}, y)) AS r{i}, min({c}) AS lo{i}, max({c}) AS hi{i}, avg({c}) AS av{i}" for i, c in enumerate(f))
    ranked = " UNION ALL ".join(f"SELECT '{c}' AS name, {i} AS k, r{i} AS r FROM fs" for i, c in enumerate(f))
    at = lambda i, c: (f"CASE WHEN a.k = {i} THEN lo{i} + (id // {k}) * ((hi{i} - lo{i}) / {k - 1}) "  # noqa: E731
                       f"WHEN b.k = {i} THEN lo{i} + (id % {k}) * ((hi{i} - lo{i}) / {k - 1}) ELSE av{i} END")
    z = "(b_const + " + " + ".join(f"raw.x{i} * ({at(i, c)})" for i, c in enumerate(f)) + ")"
    return (_RAW.rstrip() + f",\nfs AS (SELECT {first} FROM sp),\nrk AS (SELECT *, row_number() OVER (ORDER BY r DESC, name) AS place FROM ({ranked}))\n"
            f"SELECT CAST(id // {k} AS INTEGER) AS i, CAST(id % {k} AS INTEGER) AS j, a.name AS x_name, b.name AS y_name, round({z} / 1e3, 4) AS y_pred "
            f"FROM fs, raw, rk a, rk b, range({k * k}) t(id) WHERE a.place = 1 AND b.place = 2")


@query("m15_surface_top_two_items", _surface_top_two_sql())
def m15_surface_top_two_items(spark, sf_dir):
    """The regression surface over the two features most correlated with the price."""
    s = prepare(spark, sf_dir)
    corr = spark.createDataFrame([(a, b, r) for _, a, b, r, _ in _corr_rows(s.every)], "var_x string, var_y string, pearson_r double")
    fx, fy = [r.var_y for r in ST.top_abs_corr(corr, "price", 2).collect()]
    g = M.surface_grid(s.rows, _raw_fit(s), fx, fy, 20)
    return g.select("i", "j", F.lit(fx).alias("x_name"), F.lit(fy).alias("y_name"), F.round(F.col("y_pred") / 1e3, 4).alias("y_pred"))


def _bands_sql(points: int = 50) -> str:
    parts = []
    for c in GRID_FEATS:
        st = (f"SELECT count(*) AS n, regr_slope(y, {c}) AS b, regr_intercept(y, {c}) AS a, min({c}) AS lo, max({c}) AS hi FROM sp")
        parts.append(f"SELECT '{c}' AS feature, CAST(i AS INTEGER) AS i, round(lo + i * ((hi - lo) / {points - 1}), 6) AS x, "
                     f"round((a + b * (lo + i * ((hi - lo) / {points - 1}))) / 1e3, 4) AS y_hat FROM ({st}), range({points}) t(i)")
    return _GRID6 + "\nUNION ALL\n".join(parts)


@query("m17_lines_items", _bands_sql())
def m17_lines_items(spark, sf_dir):
    """The fitted line of the clipped price on each feature, from the pooled moments."""
    s = prepare(spark, sf_dir)
    out = None
    for c in GRID_FEATS:
        fit = M.ols(None, [c], "price", s.every.subset([c]))
        lo, step = s.quartiles[c]["q0"], (s.quartiles[c]["q100"] - s.quartiles[c]["q0"]) / 49
        x = F.lit(float(lo)) + F.col("id") * F.lit(float(step))
        part = spark.range(50).select(F.lit(c).alias("feature"), F.col("id").cast("int").alias("i"), F.round(x, 6).alias("x"),
                                      F.round((F.lit(fit.intercept) + F.lit(float(fit.coef[0])) * x) / 1e3, 4).alias("y_hat"))
        out = part if out is None else out.unionByName(part)
    return out


# ---------------------------------------------------------------------------
# the panel's three variants, all sections


def _variant_sql() -> str:
    std = ", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS {c}" for c in X3)
    pct = ", ".join(f"COALESCE((({c} / lag({c}) OVER (ORDER BY Date)) - 1.0) * 100.0, 0.0) AS {c}" for c in X3)
    base = Q.panel_ctes()
    return QS.variants_sql([("original", dict(base), "panel"), ("standardised", dict(base, v=f"SELECT Date, price, {std} FROM panel"), "v"),
                            ("pct_change", dict(base, v=f"SELECT Date, price, {pct} FROM panel"), "v")])


@query("m21_variant_summaries", _variant_sql())
def m21_variant_summaries(spark, sf_dir):
    """Coefficients, scores, VIF and the OLS summary of the raw price on three forms of the rates."""
    p = panel(spark, sf_dir)
    variants = {"original": p, "standardised": SC.fit_standard(p, X3).apply(p),
                "pct_change": cut_lineage(AL.pct_change(p, "Date", X3, first_zero=True, buckets=1))}
    out = None
    for name, d in variants.items():
        for part in regression_sections(spark, d)[0]:
            value = F.when(F.col("col_name") == "mse", F.round(F.col("value") / 1e6, 3)).otherwise(F.round("value", 6)) + 0.0
            part = part.select(F.lit(name).alias("variant"), "section", "row_name", "col_name", value.alias("value"))
            out = part if out is None else out.unionByName(part)
    return out


# ---------------------------------------------------------------------------
# points beyond the whiskers


@query("a14_outlier_points",
       Q.cte(it=Q.ITEMS) + ", q AS (SELECT category, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM it GROUP BY category) "
       "SELECT it.category, l_orderkey, l_linenumber, price FROM it JOIN q ON q.category = it.category "
       "WHERE price < q1 - 0.45 * (q3 - q1) OR price > q3 + 0.45 * (q3 - q1)")
def a14_outlier_points(spark, sf_dir):
    """The points a box plot draws beyond whiskers of 0.45 quartile ranges (1.5 leaves hardly any here)."""
    it = TB.item_facts(spark, sf_dir).select("category", "l_orderkey", "l_linenumber", "price")
    return ST.box_outliers(it, "price", by=["category"], whis=0.45)
