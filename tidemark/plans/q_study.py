"""Queries over the daily panel: changes, scaling, description, correlation and OLS.

The panel (one row per day) is bounded by the number of calendar days, whatever the
size of the fact table it is built from; its statistics use exact ``percentile``
where quantiles are needed.  Fact-level queries live in ``q_facts``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.clean import drop_nulls
from ..operators import align as AL
from ..operators import models as M
from ..operators import scale as SC
from ..operators import stats as ST
from . import sqlkit as Q
from . import sqlstudy as QS
from . import tables as TB
from . import items
from .catalog import _PANEL_SQL, panel, query, rnd
from .items import GRID_FEATS

X3 = Q.RATE_NAMES
COLS4 = Q.PANEL_COLS


def pct_panel(spark, sf_dir):
    """Percentage change ×100 in date order, first row dropped."""
    from ..session import cut_lineage
    p = AL.pct_change(panel(spark, sf_dir), "Date", COLS4, buckets=1)  # one row per day
    return cut_lineage(drop_nulls(p, COLS4))


def mm_panel(spark, sf_dir):
    """Min-max scaling of price and the three rates."""
    p = panel(spark, sf_dir)
    return SC.fit_minmax(p, COLS4).apply(p)


def std_panel(spark, sf_dir):
    p = panel(spark, sf_dir)
    return SC.fit_standard(p, COLS4).apply(p)


_PCT_SQL = Q.cte(**Q.panel_ctes(), pct0=Q.pct_sql("panel", COLS4),
                 pct=f"SELECT * FROM pct0 WHERE {' AND '.join(c + ' IS NOT NULL' for c in COLS4)}")
_MM_SQL = Q.cte(**Q.panel_ctes(), mm=Q.minmax_sql("panel", COLS4))
_STD_SQL = Q.cte(**Q.panel_ctes(), sd=Q.standard_sql("panel", COLS4))


@query("w3_pct_change_panel", _PCT_SQL + "SELECT * FROM pct")
def w3_pct_change_panel(spark, sf_dir):
    return pct_panel(spark, sf_dir)


@query("w4_pct_change_first_zero",
       Q.cte(rates=Q.RATES, filled=Q.filled(),
             ch=Q.pct_sql("filled", X3, first_zero=True)) + "SELECT * FROM ch")
def w4_pct_change_first_zero(spark, sf_dir):
    rates = AL.fill_both(TB.rates_wide_one_scan(spark, sf_dir), "Date")
    return AL.pct_change(rates, "Date", X3, first_zero=True)


@query("m2_minmax_panel", _MM_SQL + "SELECT * FROM mm")
def m2_minmax_panel(spark, sf_dir):
    return mm_panel(spark, sf_dir)


@query("m1_standard_panel",
       _STD_SQL + "SELECT Date, " + ", ".join(f"round({c}, 9) AS {c}" for c in COLS4) + " FROM sd")
def m1_standard_panel(spark, sf_dir):
    return rnd(std_panel(spark, sf_dir), {c: 9 for c in COLS4})


def _robust_sql():
    parts = []
    for c in COLS4:
        med = f"quantile_cont({c}, 0.5) OVER ()"
        iqr = f"(quantile_cont({c}, 0.75) OVER () - quantile_cont({c}, 0.25) OVER ())"
        parts.append(f"round(({c} - {med}) / (CASE WHEN {iqr} = 0 THEN 1.0 ELSE {iqr} END), 9) AS {c}")
    return _PANEL_SQL + "SELECT Date, " + ", ".join(parts) + " FROM panel"


@query("m3_robust_panel", _robust_sql())
def m3_robust_panel(spark, sf_dir):
    p = panel(spark, sf_dir)
    return rnd(SC.fit_robust(p, COLS4, method="percentile").apply(p), {c: 9 for c in COLS4})


def _describe_sql(src_ctes: str, src: str, cols, digits=6):
    parts = []
    for c in cols:
        parts.append(
            f"SELECT '{c}' AS variable, count({c}) AS count, round(avg({c}), {digits}) AS mean, "
            f"round(stddev_samp({c}), {digits}) AS std, round(min({c}), {digits}) AS min, "
            f"round(quantile_cont({c}, 0.25), {digits}) AS q25, "
            f"round(quantile_cont({c}, 0.5), {digits}) AS q50, "
            f"round(quantile_cont({c}, 0.75), {digits}) AS q75, round(max({c}), {digits}) AS max "
            f"FROM {src}")
    return src_ctes + "\nUNION ALL\n".join(parts)


_DESC_ROUND = {c: 6 for c in ("mean", "std", "min", "q25", "q50", "q75", "max")}


@query("a7_describe_pct_panel", _describe_sql(_PCT_SQL, "pct", COLS4))
def a7_describe_pct_panel(spark, sf_dir):
    return rnd(ST.describe(pct_panel(spark, sf_dir), COLS4, method="percentile"), _DESC_ROUND)


@query("a7_describe_mm_panel", _describe_sql(_MM_SQL, "mm", COLS4))
def a7_describe_mm_panel(spark, sf_dir):
    return rnd(ST.describe(mm_panel(spark, sf_dir), COLS4, method="rank"), _DESC_ROUND)


@query("a10_corr_pct_panel", _PCT_SQL + Q.corr_long("pct", COLS4))
def a10_corr_pct_panel(spark, sf_dir):
    return rnd(ST.corr_long(pct_panel(spark, sf_dir), COLS4), {"pearson_r": 9})


@query("a10_corr_mm_panel", _MM_SQL + Q.corr_long("mm", COLS4))
def a10_corr_mm_panel(spark, sf_dir):
    return rnd(ST.corr_long(mm_panel(spark, sf_dir), COLS4), {"pearson_r": 9})


def _variants_sql():
    ctes = dict(rates=Q.RATES, filled=Q.filled(), std=Q.standard_sql("filled", X3),
                mm=Q.minmax_sql("filled", X3), pct=Q.pct_sql("filled", X3, first_zero=True))
    parts = []
    for v, src in (("raw", "filled"), ("standard", "std"), ("minmax", "mm"), ("pct_change", "pct")):
        parts.append(f"SELECT '{v}' AS variant, * FROM ({Q.corr_long(src, X3)})")
    return Q.cte(**ctes) + "\nUNION ALL\n".join(parts)


@query("m19_corr_variants", _variants_sql())
def m19_corr_variants(spark, sf_dir):
    """The rates' correlation raw, standardised, min-max and as changes."""
    from ..session import cut_lineage
    # one row per day, read by four variants: filled once and materialised
    rates = cut_lineage(AL.fill_both(TB.rates_wide_one_scan(spark, sf_dir), "Date", buckets=1))
    variants = {
        "raw": rates,
        "standard": SC.fit_standard(rates, X3).apply(rates),
        "minmax": SC.fit_minmax(rates, X3).apply(rates),
        "pct_change": AL.pct_change(rates, "Date", X3, first_zero=True),
    }
    out = None
    for name, d in variants.items():
        c = ST.corr_long(d, X3).select(F.lit(name).alias("variant"), "*")
        out = c if out is None else out.unionByName(c)
    return rnd(out, {"pearson_r": 9})


@query("m22_long_series_panel",
       _MM_SQL + "\nUNION ALL\n".join(
           f"SELECT Date, '{c}' AS series, {c} AS value FROM mm" for c in COLS4))
def m22_long_series_panel(spark, sf_dir):
    return M.long_series(mm_panel(spark, sf_dir), "Date", COLS4)


# ---------------------------------------------------------------------------
# the min-max OLS study (train/test split, coefficients, scores, VIF, summary)

_SPLIT_MM = Q.cte(**Q.panel_ctes(), mm=Q.minmax_sql("panel", COLS4), sp=Q.split_sql("mm"),
                  train="SELECT * FROM sp WHERE NOT is_test",
                  g=Q.gram3_sql("train", X3, "price"), inv=Q.inv3_sql("g"),
                  co=Q.ols3_coef_sql("inv"))


def mm_split(spark, sf_dir):
    # the panel is checkpointed; scaling and the split flag are column expressions over it
    return M.train_test_split(mm_panel(spark, sf_dir), ["Date"], 0.2, 42)


@query("m4_split_sizes",
       Q.cte(**Q.panel_ctes(), mm=Q.minmax_sql("panel", COLS4), sp=Q.split_sql("mm"))
       + "SELECT is_test, count(*) AS n, round(sum(price), 6) AS sum_price FROM sp GROUP BY is_test")
def m4_split_sizes(spark, sf_dir):
    s = mm_split(spark, sf_dir)
    return s.groupBy("is_test").agg(F.count(F.lit(1)).alias("n"),
                                    F.round(F.sum("price"), 6).alias("sum_price"))


@query("m5_ols_coefficients",
       _SPLIT_MM + "\nUNION ALL\n".join(
           [f"SELECT 'const' AS feature, round(b_const, 6) AS coef FROM co"]
           + [f"SELECT '{c}' AS feature, round(b{i}, 6) AS coef FROM co" for i, c in enumerate(X3)]))
def m5_ols_coefficients(spark, sf_dir):
    s = mm_split(spark, sf_dir)
    fit = M.ols(s.where(~F.col("is_test")), X3, "price")
    return rnd(fit.coef_df(spark), {"coef": 6})


def _pred_sql(src):
    return f"(b_const + b0 * {src}.CNY_JPY + b1 * {src}.PHP_JPY + b2 * {src}.VND_JPY)"


@query("m10_ols_test_scores",
       _SPLIT_MM + f"""SELECT 0 AS model_no, 'ols' AS model,
round(avg((sp.price - {_pred_sql('sp')}) ^ 2), 6) AS mse,
round(1 - avg((sp.price - {_pred_sql('sp')}) ^ 2) / var_pop(sp.price), 6) AS r2
FROM sp, co WHERE sp.is_test""")
def m10_ols_test_scores(spark, sf_dir):
    s = mm_split(spark, sf_dir)
    fit = M.ols(s.where(~F.col("is_test")), X3, "price")
    return rnd(M.scores(s, [fit], "price", where=F.col("is_test")), {"mse": 6, "r2": 6})


@query("m9_predict_all_rows",
       _SPLIT_MM + f"SELECT sp.Date, round({_pred_sql('sp')}, 6) AS y_pred, "
       f"round(sp.price - {_pred_sql('sp')}, 6) AS residual FROM sp, co")
def m9_predict_all_rows(spark, sf_dir):
    s = mm_split(spark, sf_dir)
    fit = M.ols(s.where(~F.col("is_test")), X3, "price")
    out = fit.predict(s, "y_pred").select("Date", "y_pred",
                                          (F.col("price") - F.col("y_pred")).alias("residual"))
    return rnd(out, {"y_pred": 6, "residual": 6})


def _vif_const_sql(src_ctes, src):
    g = Q.gram3_sql(src, X3, None)
    inv = Q.inv3_sql("g")
    ctes = src_ctes.rstrip() + f",\ng AS ({g}),\ninv AS ({inv})\n"
    mu = ["m0", "m1", "m2"]
    ii = {(0, 0): "i00", (0, 1): "i01", (0, 2): "i02", (1, 0): "i01", (1, 1): "i11",
          (1, 2): "i12", (2, 0): "i02", (2, 1): "i12", (2, 2): "i22"}
    quad = " + ".join(f"{mu[i]} * {ii[(i, j)]} * {mu[j]}" for i in range(3) for j in range(3))
    parts = [f"SELECT 'const' AS feature, round(1 + {quad}, 6) AS vif FROM inv"]
    for i, c in enumerate(X3):
        parts.append(f"SELECT '{c}' AS feature, round(s{i}{i} * i{i}{i}, 6) AS vif FROM inv")
    return ctes + "\nUNION ALL\n".join(parts)


@query("m11_vif_const_mm", _vif_const_sql(_MM_SQL, "mm"))
def m11_vif_const_mm(spark, sf_dir):
    return rnd(M.vif_df(spark, M.vif(mm_panel(spark, sf_dir), X3, constant=True)), {"vif": 6})


@query("m11_vif_const_pct", _vif_const_sql(_PCT_SQL, "pct"))
def m11_vif_const_pct(spark, sf_dir):
    return rnd(M.vif_df(spark, M.vif(pct_panel(spark, sf_dir), X3, constant=True)), {"vif": 6})


def _vif_noconst_sql(src_ctes, src):
    # uncentred X'X = n (S + m mᵀ); VIF_j = (X'X)_jj [(X'X)^-1]_jj
    g = Q.gram3_sql(src, X3, None)
    u = ("SELECT n, " + ", ".join(f"s{i}{j} + m{i} * m{j} AS s{i}{j}"
                                  for i in range(3) for j in range(i, 3)) + " FROM g")
    ctes = src_ctes.rstrip() + f",\ng AS ({g}),\nu AS ({u}),\ninv AS ({Q.inv3_sql('u')})\n"
    parts = [f"SELECT '{c}' AS feature, round(s{i}{i} * i{i}{i}, 6) AS vif FROM inv"
             for i, c in enumerate(X3)]
    return ctes + "\nUNION ALL\n".join(parts)


@query("m12_vif_no_const_panel", _vif_noconst_sql(_PANEL_SQL, "panel"))
def m12_vif_no_const_panel(spark, sf_dir):
    return rnd(M.vif_df(spark, M.vif(panel(spark, sf_dir), X3, constant=False)), {"vif": 6})


def _summary_ctes():
    e = f"(train.price - {_pred_sql('train')})"
    res = f"SELECT train.Date, {e} AS e FROM train, co"
    mom = ("SELECT count(*) AS n, sum(e * e) AS sse, avg(e) AS me FROM res")
    cm = ("SELECT n, sse, sum((e - me) ^ 2) / n AS c2, sum((e - me) ^ 3) / n AS c3, "
          "sum((e - me) ^ 4) / n AS c4 FROM res, mom GROUP BY n, sse")
    dw = "SELECT sum((e - pe) ^ 2) AS ssd FROM (SELECT e, lag(e) OVER (ORDER BY Date) AS pe FROM res)"
    ctes = _SPLIT_MM.rstrip() + f",\nres AS ({res}),\nmom AS ({mom}),\ncm AS ({cm}),\ndw AS ({dw}),\n"
    ctes += ("st AS (SELECT cm.n AS n, 1 - cm.sse / (g.syy * g.n) AS r2, cm.sse AS sse, "
             "c3 / c2 ^ 1.5 AS skew, c4 / (c2 * c2) AS kurt, dw.ssd / cm.sse AS dw FROM cm, g, dw)\n")
    return ctes


def _summary_core_sql():
    k = 4
    stats = {
        "n": "n", "r2": "r2", "adj_r2": f"1 - (1 - r2) * (n - 1) / (n - {k})",
        "f_stat": f"(r2 / 3) / ((1 - r2) / (n - {k}))",
        "log_likelihood": "-n / 2.0 * (ln(2 * pi()) + ln(sse / n) + 1)",
        "aic": f"n * (ln(2 * pi()) + ln(sse / n) + 1) + 2 * {k}",
        "bic": f"n * (ln(2 * pi()) + ln(sse / n) + 1) + {k} * ln(n)",
        "skew": "skew", "kurtosis": "kurt",
        "jarque_bera": "n / 6.0 * (skew * skew + (kurt - 3) * (kurt - 3) / 4.0)",
        "durbin_watson": "dw",
    }
    return _summary_ctes() + "\nUNION ALL\n".join(
        f"SELECT '{k_}' AS stat, round({v}, 6) AS value FROM st" for k_, v in stats.items())


_CORE_STATS = ["n", "r2", "adj_r2", "f_stat", "log_likelihood", "aic", "bic", "skew", "kurtosis",
               "jarque_bera", "durbin_watson"]


def _mm_summary(spark, sf_dir):
    s = mm_split(spark, sf_dir)
    train = s.where(~F.col("is_test"))
    return M.ols_summary(train, X3, "price", order="Date", buckets=1)


@query("m8_ols_summary_core", _summary_core_sql())
def m8_ols_summary_core(spark, sf_dir):
    sm = _mm_summary(spark, sf_dir)
    rows = [(k, float(sm.stats[k])) for k in _CORE_STATS]
    return rnd(spark.createDataFrame(rows, "stat string, value double"), {"value": 6})


_MM_PARTS = dict(**Q.panel_ctes(), mm=Q.minmax_sql("panel", COLS4))
_PCT_PARTS = dict(**Q.panel_ctes(), pct0=Q.pct_sql("panel", COLS4),
                  pct=f"SELECT * FROM pct0 WHERE {' AND '.join(c + ' IS NOT NULL' for c in COLS4)}")


@query("m8_ols_summary_full", QS.cte_text(QS.study_ctes(_MM_PARTS, "mm")) + QS.stats_select())
def m8_ols_summary_full(spark, sf_dir):
    """All summary numbers, with p-values, Omnibus and condition number."""
    return rnd(_mm_summary(spark, sf_dir).stats_df(spark), {"value": 6})


@query("m8_ols_coef_table", QS.cte_text(QS.study_ctes(_MM_PARTS, "mm")) + QS.coef_select())
def m8_ols_coef_table(spark, sf_dir):
    t = _mm_summary(spark, sf_dir).coef_table_df(spark)
    return rnd(t, {c: 6 for c in ("coef", "std_err", "t", "p_value", "ci_low", "ci_high")})


@query("m20_verdict",
       _SPLIT_MM.rstrip() + f""",
st AS (SELECT 1 - avg((sp.price - {_pred_sql('sp')}) ^ 2) / var_pop(sp.price) AS r2 FROM sp, co WHERE sp.is_test)
SELECT round(r2, 6) AS r2, CASE WHEN r2 < 0.3 THEN 'weak' WHEN r2 >= 0.7 THEN 'strong'
ELSE 'moderate' END AS verdict FROM st""")
def m20_verdict(spark, sf_dir):
    """The verdict is on the test rows' R² (M10), not on the fit's own."""
    s = mm_split(spark, sf_dir)
    fit = M.ols(s.where(~F.col("is_test")), X3, "price")
    df = M.scores(s, [fit], "price", where=F.col("is_test")).select("r2")
    return rnd(df.withColumn("verdict", M.verdict("r2")), {"r2": 6})


@query("a12_polyfit_per_feature",
       _PANEL_SQL + "\nUNION ALL\n".join(
           f"SELECT '{c}' AS feature, round(regr_slope(price, {c}), 9) AS slope, "
           f"round(regr_intercept(price, {c}), 6) AS intercept, CAST(regr_count(price, {c}) AS BIGINT) AS n FROM panel"
           for c in X3))
def a12_polyfit_per_feature(spark, sf_dir):
    return rnd(ST.polyfit_per_feature(panel(spark, sf_dir), X3, "price"),
               {"slope": 9, "intercept": 6})


@query("o4_top_abs_corr",
       _MM_SQL + f"SELECT * FROM ({Q.corr_long('mm', COLS4)}) WHERE var_x = 'price' "
       "AND var_y <> 'price' ORDER BY abs(pearson_r) DESC, var_y LIMIT 2")
def o4_top_abs_corr(spark, sf_dir):
    c = rnd(ST.corr_long(mm_panel(spark, sf_dir), COLS4), {"pearson_r": 9})
    return ST.top_abs_corr(c, "price", 2)


@query("a2_monthly_panel_means",
       _PANEL_SQL + "SELECT CAST(year(Date) AS INTEGER) AS Year, CAST(month(Date) AS INTEGER) AS Month, "
       + ", ".join(f"round(avg({c}), 6) AS {c}" for c in COLS4)
       + ", make_date(CAST(year(Date) AS INTEGER), CAST(month(Date) AS INTEGER), 1) AS Date "
       "FROM panel GROUP BY 1, 2")
def a2_monthly_panel_means(spark, sf_dir):
    from ..functions.dates import month_start
    p = panel(spark, sf_dir).withColumns({"Year": F.year("Date"), "Month": F.month("Date")})
    m = ST.mean_by(p, ["Year", "Month"], COLS4)
    m = m.withColumn("Date", month_start(F.col("Year"), F.col("Month")))
    return rnd(m, {c: 6 for c in COLS4})


@query("a10_corr_monthly_panel",
       Q.cte(**Q.panel_ctes(), mo="SELECT year(Date) AS Y, month(Date) AS Mo, "
             + ", ".join(f"avg({c}) AS {c}" for c in COLS4) + " FROM panel GROUP BY 1, 2")
       + Q.corr_long("mo", COLS4, digits=6))
def a10_corr_monthly_panel(spark, sf_dir):
    p = panel(spark, sf_dir).withColumns({"Y": F.year("Date"), "Mo": F.month("Date")})
    return rnd(ST.corr_long(ST.mean_by(p, ["Y", "Mo"], COLS4), COLS4), {"pearson_r": 6})


# ---------------------------------------------------------------------------
# The model grid of the item-level study

def grid_fits(spark, sf_dir):
    """[(label, scaling, fit, (test MSE, test R²))] of the six models."""
    return [(label, sc, fit, (mse, r2)) for label, sc, fit, mse, r2 in items.grid(items.prepare(spark, sf_dir))]


def _vif_noconst4_sql():
    from .q_facts import _M21_SQL
    feats = GRID_FEATS
    where = " AND ".join(f"{c} IS NOT NULL" for c in feats)
    parts = []
    ctes = _M21_SQL.rstrip() + f",\ncr AS (SELECT * FROM m21 WHERE {where})"
    for j, fj in enumerate(feats):
        o = [c for c in feats if c != fj]
        sel = [f"avg({fj} * {fj}) AS q"]
        for a in range(3):
            for b in range(a, 3):
                sel.append(f"avg({o[a]} * {o[b]}) AS s{a}{b}")
        sel += [f"avg({o[a]} * {fj}) AS t{a}" for a in range(3)]
        ctes += f",\nu{j} AS (SELECT {', '.join(sel)} FROM cr),\nv{j} AS ({Q.inv3_sql(f'u{j}')})"
        ii = {(0, 0): "i00", (0, 1): "i01", (0, 2): "i02", (1, 0): "i01", (1, 1): "i11",
              (1, 2): "i12", (2, 0): "i02", (2, 1): "i12", (2, 2): "i22"}
        quad = " + ".join(f"t{a} * {ii[(a, b)]} * t{b}" for a in range(3) for b in range(3))
        parts.append(f"SELECT '{fj}' AS feature, round(q / (q - ({quad})), 6) AS vif FROM v{j}")
    return ctes + "\n" + "\nUNION ALL\n".join(parts)


@query("m12_vif_no_const_items", _vif_noconst4_sql())
def m12_vif_no_const_items(spark, sf_dir):
    from .q_facts import merged_all
    d = M.complete_rows(merged_all(spark, sf_dir), GRID_FEATS)
    return rnd(M.vif_df(spark, M.vif(d, GRID_FEATS, constant=False)), {"vif": 6})


# ---------------------------------------------------------------------------
# M15, M17, M18


def _surface_sql(k: int = 20):
    st = ("SELECT min(CNY_JPY) AS lx, max(CNY_JPY) AS hx, min(PHP_JPY) AS ly, max(PHP_JPY) AS hy, "
          "avg(VND_JPY) AS mv FROM mm")
    grid = (f"SELECT CAST(id // {k} AS INTEGER) AS i, CAST(id % {k} AS INTEGER) AS j, "
            f"lx + (id // {k}) * ((hx - lx) / {k - 1}) AS CNY_JPY, "
            f"ly + (id % {k}) * ((hy - ly) / {k - 1}) AS PHP_JPY, mv AS VND_JPY FROM st, range({k * k}) t(id)")
    return (_SPLIT_MM.rstrip() + f",\nst AS ({st}),\ngr AS ({grid})\n"
            "SELECT i, j, round(gr.CNY_JPY, 6) AS CNY_JPY, round(gr.PHP_JPY, 6) AS PHP_JPY, "
            "round(gr.VND_JPY, 6) AS VND_JPY, round(b_const + b0 * gr.CNY_JPY + b1 * gr.PHP_JPY "
            "+ b2 * gr.VND_JPY, 6) AS y_pred FROM gr, co")


@query("m15_regression_surface", _surface_sql())
def m15_regression_surface(spark, sf_dir):
    s = mm_split(spark, sf_dir)
    fit = M.ols(s.where(~F.col("is_test")), X3, "price")
    g = M.surface_grid(mm_panel(spark, sf_dir), fit, "CNY_JPY", "PHP_JPY", 20)
    return rnd(g, {c: 6 for c in ("CNY_JPY", "PHP_JPY", "VND_JPY", "y_pred")})


def _bootstrap_sql(points: int = 100, n_boot: int = 1000, level: float = 0.95) -> str:
    drawn = "CAST('0x' || substr(md5(CAST(Date AS VARCHAR) || '|42|' || CAST(b // 8 AS VARCHAR)), CAST(b % 8 AS INTEGER) * 4 + 1, 4) AS INTEGER)"
    weight = " + ".join(f"CASE WHEN u >= {c} THEN 1 ELSE 0 END" for c in M.poisson_cuts())
    tail = (1 - level) / 2
    return (_MM_SQL.rstrip() + ",\nd AS (SELECT Date, CNY_JPY AS x, price AS y FROM mm WHERE CNY_JPY IS NOT NULL AND price IS NOT NULL),\n"
            "f AS (SELECT regr_slope(y, x) AS s, regr_intercept(y, x) AS c, min(x) AS lo, max(x) AS hi FROM d),\n"
            f"u AS (SELECT b, x, y, {drawn} AS u FROM d, range({n_boot}) t(b)),\nw AS (SELECT b, x, y, {weight} AS w FROM u),\n"
            "s AS (SELECT b, sum(w) AS n, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy FROM w GROUP BY b),\n"
            "l AS (SELECT b, (sxy - sx * sy / n) / (sxx - sx * sx / n) AS slope, sy / n AS my, sx / n AS mx FROM s WHERE sxx - sx * sx / n > 1e-9),\n"
            f"g AS (SELECT CAST(i AS INTEGER) AS i, lo + i * ((hi - lo) / {points - 1}) AS x, s, c FROM f, range({points}) t(i))\n"
            "SELECT g.i, round(g.x, 6) AS x, round(c + s * g.x, 6) AS y_hat, "
            f"round(quantile_cont(my + slope * (g.x - mx), {tail}), 6) AS lo, round(quantile_cont(my + slope * (g.x - mx), {1 - tail}), 6) AS hi "
            "FROM g, l GROUP BY g.i, g.x, c, s")


@query("m17_regression_band", _bootstrap_sql())
def m17_regression_band(spark, sf_dir):
    """The band of 1000 resampled fits."""
    band = M.bootstrap_band(mm_panel(spark, sf_dir), "CNY_JPY", "price", "Date")
    return rnd(band, {c: 6 for c in ("x", "y_hat", "lo", "hi")})


def _pair_bins_sql(bins: int = 10):
    st = "SELECT " + ", ".join(f"min({c}) AS lo_{i}, max({c}) AS hi_{i}" for i, c in enumerate(COLS4)) + " FROM mm"
    cells = []
    for i, a in enumerate(COLS4):
        for j, b in enumerate(COLS4):
            ca = (f"CAST(least({bins - 1}, floor(({a} - lo_{i}) * {bins} / "
                  f"(CASE WHEN hi_{i} = lo_{i} THEN 1.0 ELSE hi_{i} - lo_{i} END))) AS INTEGER)")
            cb = (f"CAST(least({bins - 1}, floor(({b} - lo_{j}) * {bins} / "
                  f"(CASE WHEN hi_{j} = lo_{j} THEN 1.0 ELSE hi_{j} - lo_{j} END))) AS INTEGER)")
            cells.append(f"SELECT '{a}' AS x_name, '{b}' AS y_name, {ca} AS x_bin, {cb} AS y_bin FROM mm, st")
    return (_MM_SQL.rstrip() + f",\nst AS ({st}),\ncells AS ({' UNION ALL '.join(cells)})\n"
            "SELECT x_name, y_name, x_bin, y_bin, count(*) AS count FROM cells GROUP BY 1, 2, 3, 4")


@query("m18_pair_bins", _pair_bins_sql())
def m18_pair_bins(spark, sf_dir):
    return M.pair_bins(mm_panel(spark, sf_dir), COLS4, 10)


# ---------------------------------------------------------------------------
# K4 reports and small column operators


@query("k4_minmax_study_report", QS.report_sql(_MM_PARTS, "mm", "min-max scaled daily panel"))
def k4_minmax_study_report(spark, sf_dir):
    from .studies import study_report
    return rnd(study_report(spark, mm_panel(spark, sf_dir), "min-max scaled daily panel"), {"value": 6}).withColumn("value", F.col("value") + 0.0)


@query("k4_pct_change_study_report", QS.report_sql(_PCT_PARTS, "pct", "percentage-change daily panel"))
def k4_pct_change_study_report(spark, sf_dir):
    from .studies import study_report
    return rnd(study_report(spark, pct_panel(spark, sf_dir), "percentage-change daily panel"), {"value": 6}).withColumn("value", F.col("value") + 0.0)


@query("p10_backup_then_scale",
       Q.cte(**Q.panel_ctes(), mm=Q.minmax_sql("panel", COLS4))
       + "SELECT mm.*, " + ", ".join(f"panel.{c} AS {c}_original" for c in COLS4)
       + " FROM mm JOIN panel ON mm.Date = panel.Date")
def p10_backup_then_scale(spark, sf_dir):
    """Keep each column's raw value as ``<col>_original`` before scaling it."""
    from ..functions.clean import backup_columns
    p = backup_columns(panel(spark, sf_dir), COLS4)
    return SC.fit_minmax(p, COLS4).apply(p)


@query("p11p12_drop_by_position",
       Q.cte(rates=Q.RATES) + "SELECT PHP_JPY AS php FROM rates")
def p11p12_drop_by_position(spark, sf_dir):
    """Drop columns 0, 1 and 3 by position, then rename what is left."""
    from ..functions.clean import drop_by_position, project_rename
    r = drop_by_position(TB.rates_wide(spark, sf_dir), [0, 1, 3])
    return project_rename(r, {"PHP_JPY": "php"})


@query("p14_price_bands",
       Q.cte(daily=Q.DAILY) + "SELECT CASE WHEN price BETWEEN 6000000 AND 1e12 THEN 'high' "
       "WHEN price BETWEEN 0 AND 2500000 THEN 'low' END AS band, count(*) AS n FROM daily GROUP BY 1")
def p14_price_bands(spark, sf_dir):
    """A broken axis: label each daily mean with the band that shows it."""
    from ..functions.clean import value_band
    d = TB.daily_price(spark, sf_dir)
    b = d.select(value_band("price", {"high": (6_000_000, 1e12), "low": (0, 2_500_000)}).alias("band"))
    return b.groupBy("band").agg(F.count(F.lit(1)).alias("n"))


def _coef_se_sql():
    # Sxx = n·S (population covariance), so inv(Sxx) = inv(S)/n; σ² = SSE/(n − 4)
    ii = {(0, 0): "i00", (0, 1): "i01", (0, 2): "i02", (1, 0): "i01", (1, 1): "i11",
          (1, 2): "i12", (2, 0): "i02", (2, 1): "i12", (2, 2): "i22"}
    quad = " + ".join(f"co.m{i} * {ii[(i, j)]} * co.m{j}" for i in range(3) for j in range(3))
    sig = "(cm.sse / (cm.n - 4))"
    parts = [f"SELECT 'const' AS term, round(b_const, 6) AS coef, "
             f"round(sqrt({sig} * (1.0 / cm.n + ({quad}) / cm.n)), 6) AS std_err, "
             f"round(b_const / sqrt({sig} * (1.0 / cm.n + ({quad}) / cm.n)), 6) AS t FROM co, cm"]
    for i, c in enumerate(X3):
        parts.append(f"SELECT '{c}' AS term, round(b{i}, 6) AS coef, round(sqrt({sig} * i{i}{i} / cm.n), 6) "
                     f"AS std_err, round(b{i} / sqrt({sig} * i{i}{i} / cm.n), 6) AS t FROM co, cm")
    return _summary_ctes() + "\nUNION ALL\n".join(parts)


@query("m8_coef_std_err_t", _coef_se_sql())
def m8_coef_std_err_t(spark, sf_dir):
    """The OLS coefficient table's coef, standard error and t (p-values and intervals,
    which need the t distribution, are in ``m8_ols_coef_table``)."""
    t = _mm_summary(spark, sf_dir).coef_table_df(spark).select("term", "coef", "std_err", "t")
    return rnd(t, {"coef": 6, "std_err": 6, "t": 6})
