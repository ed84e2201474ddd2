"""Statistics and models against NumPy closed forms, plus the golden-report self-check."""

import math

import numpy as np
import pandas as pd
import pytest

from tidemark.functions import dist
from tidemark.operators import models as M
from tidemark.operators import scale as SC
from tidemark.operators import stats as ST
from tidemark.operators import wide


@pytest.fixture(scope="module")
def xy(spark):
    rng = np.random.default_rng(7)
    n = 300
    x = rng.normal(size=(n, 3))
    x[:, 2] = x[:, 0] * 0.6 + rng.normal(scale=0.5, size=n)
    y = 1.5 + x @ np.array([0.8, -0.4, 0.3]) + rng.normal(scale=0.7, size=n)
    pdf = pd.DataFrame({"id": np.arange(n), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y})
    return spark.createDataFrame(pdf), pdf


def test_quantiles_rank_equals_numpy(spark, xy, many_buckets):
    df, pdf = xy
    q = ST.quantiles(df, ["a", "y"], [0.05, 0.25, 0.5, 0.75, 0.95], method="rank").toPandas()
    for var in ("a", "y"):
        row = q[q.variable == var].iloc[0]
        exp = np.percentile(pdf[var], [5, 25, 50, 75, 95])
        np.testing.assert_allclose([row.q5, row.q25, row.q50, row.q75, row.q95], exp, rtol=1e-12)


def test_quantiles_grouped_with_ties(spark, many_buckets):
    rows = [(g, float(v)) for g in ("p", "q") for v in [1, 1, 1, 2, 5, 5, 9]] + [("q", 100.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = ST.quantiles(df, ["v"], [0.25, 0.5, 0.9], by=["g"]).toPandas().set_index("g")
    pdf = pd.DataFrame(rows, columns=["g", "v"])
    for g, sub in pdf.groupby("g"):
        np.testing.assert_allclose(got.loc[g, ["q25", "q50", "q90"]].to_numpy(float),
                                   np.percentile(sub.v, [25, 50, 90]))


def test_corr_constant_column_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (2.0, 2.0, 1.0), (3.0, 2.0, 2.0)], "a double, k double, b double")
    c = {(r.var_x, r.var_y): r.pearson_r for r in ST.corr_long(df, ["a", "k", "b"]).collect()}
    assert c[("a", "k")] is None and c[("k", "k")] is None and abs(c[("a", "a")] - 1) < 1e-12
    assert abs(c[("a", "b")] - np.corrcoef([1, 2, 3], [3, 1, 2])[0, 1]) < 1e-12


def test_scalers_constant_and_range(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (2.0, 5.0)], "x double, k double")
    mm = SC.fit_minmax(df, ["x", "k"]).apply(df).toPandas()
    assert mm.x.min() == 0.0 and mm.x.max() == 1.0 and (mm.k == 0).all()
    st = SC.fit_standard(df, ["x", "k"]).apply(df).toPandas()
    assert abs(st.x.std(ddof=0) - 1) < 1e-12 and (st.k == 0).all()
    rb = SC.fit_robust(df, ["x", "k"]).apply(df).toPandas()
    assert (rb.k == 0).all() and rb.x.tolist() == [-1.0, 1.0, 0.0]


def test_ols_ridge_lasso_closed_form(spark, xy):
    df, pdf = xy
    X = pdf[["a", "b", "c"]].to_numpy()
    y = pdf.y.to_numpy()
    Xc, yc = X - X.mean(0), y - y.mean()
    fit = M.ols(df, ["a", "b", "c"], "y")
    beta = np.linalg.lstsq(np.c_[np.ones(len(y)), X], y, rcond=None)[0]
    np.testing.assert_allclose([fit.intercept, *fit.coef], beta, rtol=1e-9)
    rid = M.ridge(df, ["a", "b", "c"], "y", 1.0, fit.gram)
    np.testing.assert_allclose(rid.coef, np.linalg.solve(Xc.T @ Xc + np.eye(3), Xc.T @ yc), rtol=1e-9)
    las = M.lasso(df, ["a", "b", "c"], "y", 0.1, fit.gram)
    # KKT conditions of min |yc - Xc w|²/(2n) + α|w|₁
    g = Xc.T @ (yc - Xc @ las.coef) / len(y)
    for j, w in enumerate(las.coef):
        if w != 0:
            assert abs(g[j] - 0.1 * np.sign(w)) < 1e-8
        else:
            assert abs(g[j]) <= 0.1 + 1e-8


def test_ols_summary_and_vif(spark, xy):
    df, pdf = xy
    sm = M.ols_summary(df, ["a", "b", "c"], "y", order="id")
    n, k = len(pdf), 4
    X = np.c_[np.ones(n), pdf[["a", "b", "c"]].to_numpy()]
    y = pdf.y.to_numpy()
    beta = np.linalg.lstsq(X, y, rcond=None)[0]
    e = y - X @ beta
    sse = e @ e
    r2 = 1 - sse / ((y - y.mean()) ** 2).sum()
    llf = -n / 2 * (math.log(2 * math.pi) + math.log(sse / n) + 1)
    s = sm.stats
    assert abs(s["r2"] - r2) < 1e-10 and abs(s["log_likelihood"] - llf) < 1e-8
    assert abs(s["aic"] - (-2 * llf + 2 * k)) < 1e-8
    assert abs(s["durbin_watson"] - (np.diff(e) ** 2).sum() / sse) < 1e-9
    cov = sse / (n - k) * np.linalg.inv(X.T @ X)
    np.testing.assert_allclose([t[2] for t in sm.table], np.sqrt(np.diag(cov)), rtol=1e-8)
    ev = np.linalg.eigvalsh(X.T @ X)
    assert abs(s["cond_no"] - math.sqrt(ev.max() / ev.min())) < 1e-6
    # VIF with constant: regress each column of [1, X] on the others (statsmodels' definition)
    vif = dict(M.vif(df, ["a", "b", "c"], constant=True))
    for j, name in enumerate(["const", "a", "b", "c"]):
        others = np.delete(X, j, axis=1)
        coef = np.linalg.lstsq(others, X[:, j], rcond=None)[0]
        res = X[:, j] - others @ coef
        tss = ((X[:, j] - X[:, j].mean()) ** 2).sum() if j > 0 else (X[:, j] ** 2).sum()
        assert abs(vif[name] - 1 / (res @ res / tss)) < 1e-8 * vif[name]
    vnc = dict(M.vif(df, ["a", "b", "c"], constant=False))
    Xn = X[:, 1:]
    for j, name in enumerate(["a", "b", "c"]):
        others = np.delete(Xn, j, axis=1)
        res = Xn[:, j] - others @ np.linalg.lstsq(others, Xn[:, j], rcond=None)[0]
        assert abs(vnc[name] - (Xn[:, j] @ Xn[:, j]) / (res @ res)) < 1e-8 * vnc[name]


def test_collinear_vif_does_not_crash(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, float(i % 3)) for i in range(20)], "a double, b double, c double")
    v = dict(M.vif(df, ["a", "b", "c"]))
    assert all(math.isinf(x) or x > 1e6 for k, x in v.items() if k in ("a", "b"))


def test_split_exact_count(spark, many_buckets):
    df = spark.range(457).withColumnRenamed("id", "k")
    s = M.train_test_split(df, ["k"], 0.2, 42)
    assert s.where("is_test").count() == 92 and s.count() == 457


def test_distribution_tails():
    assert abs(float(dist.t_sf(2.0, 10)) - 0.036694017385370196) < 1e-12
    assert abs(dist.t_ppf(0.975, 361) - 1.9665571) < 1e-6
    assert abs(float(dist.f_sf(3.0, 3, 50)) - 0.039) < 1e-3
    assert abs(float(dist.chi2_sf_2dof(5.991464547107979)) - 0.05) < 1e-12


def test_golden_report_algebra():
    """Feed the printed moments of the min-max study to our VIF / AIC / BIC / JB formulas."""
    corr = np.array([[1, 0.893986, 0.972662], [0.893986, 1, 0.890036], [0.972662, 0.890036, 1]])
    vif, _ = M.inflation(corr)
    np.testing.assert_allclose(vif, [19.967823, 5.181247, 19.290795], rtol=2e-4)
    mean = np.array([0.398127, 0.439861, 0.381311])
    sd = np.array([0.274480, 0.272413, 0.289360]) * math.sqrt(457 / 458)  # ddof 1 → population
    S = corr * np.outer(sd, sd)
    assert abs(1 + mean @ np.linalg.solve(S, mean) - 3.917654) < 2e-3
    n, k, llf = 366, 4, 344.61
    assert abs(-2 * llf + 2 * k - (-681.2)) < 0.05 and abs(-2 * llf + k * math.log(n) - (-665.6)) < 0.05
    jb = n / 6 * (0.160 ** 2 + (9.138 - 3) ** 2 / 4)
    assert abs(jb - 576.071) < 0.5
    k2, _ = M.omnibus(0.160, 9.138, n)
    assert abs(k2 - 57.493) < 1.0


def test_histogram_auto_bins_matches_numpy(spark, xy):
    df, pdf = xy
    h = ST.histogram(df, "y").orderBy("bin").toPandas()
    counts, edges = np.histogram(pdf.y, bins="auto")
    some = np.flatnonzero(counts)          # empty bins are left out
    assert h["bin"].tolist() == some.tolist() and set(h["n_bins"]) == {len(counts)}
    assert h["count"].tolist() == counts[some].tolist()
    np.testing.assert_allclose(h["lo"].to_numpy(), edges[some], rtol=1e-12)


def test_histogram_of_a_long_tail_has_few_rows(spark):
    df = spark.createDataFrame([(float(i % 10),) for i in range(3000)] + [(1e9,)], "y double")
    h = ST.histogram(df, "y").collect()
    assert len(h) <= 11 and sum(r["count"] for r in h) == 3001 and h[0]["n_bins"] > 10_000


def test_kde_matches_direct_sum(spark, xy):
    df, pdf = xy
    k = ST.kde_grid(df, "y", grid_size=50).orderBy("i").toPandas()
    y = pdf.y.to_numpy()
    h = y.std(ddof=1) * len(y) ** (-0.2)
    grid = np.linspace(y.min(), y.max(), 50)
    dens = np.exp(-0.5 * ((grid[:, None] - y[None, :]) / h) ** 2).sum(1) / (len(y) * h * math.sqrt(2 * math.pi))
    np.testing.assert_allclose(k.density.to_numpy(), dens, rtol=1e-10)


def test_box_stats_whiskers(spark):
    vals = [1.0, 2.0, 3.0, 4.0, 100.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    b = ST.box_stats(df, "x").first()
    assert (b.q1, b.median, b.q3) == (2.0, 3.0, 4.0)
    assert (b.whisker_lo, b.whisker_hi, b.n_outliers) == (1.0, 4.0, 1)


def test_qq_pairs(spark, xy):
    from statistics import NormalDist
    df, pdf = xy
    q = M.qq_pairs(df, "y", "id").orderBy("i").toPandas()
    n = len(pdf)
    exp_t = [NormalDist().inv_cdf(i / (n + 1)) for i in range(1, n + 1)]
    np.testing.assert_allclose(q.theoretical.to_numpy(), exp_t, atol=1e-8)
    z = np.sort((pdf.y - pdf.y.mean()) / pdf.y.std(ddof=0))
    np.testing.assert_allclose(q["sample"].to_numpy(), z, rtol=1e-9)


def test_linregress_matches_numpy(spark, xy):
    df, pdf = xy
    r = ST.linregress(df, "a", "y").first()
    slope, intercept = np.polyfit(pdf.a, pdf.y, 1)
    assert abs(r.slope - slope) < 1e-10 and abs(r.intercept - intercept) < 1e-10
    rr = np.corrcoef(pdf.a, pdf.y)[0, 1]
    se = math.sqrt((1 - rr ** 2) * ((pdf.y - pdf.y.mean()) ** 2).sum() / ((pdf.a - pdf.a.mean()) ** 2).sum() / 298)
    assert abs(r.stderr - se) < 1e-10
    t = rr * math.sqrt(298 / (1 - rr ** 2))
    assert abs(r.pvalue - 2 * float(dist.t_sf(abs(t), 298))) < 1e-12


def test_gram_fits_match_spark_ml(spark, xy):
    """Cross-check the Gram solves with Spark ML's normal-equation and elastic-net fits."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    df, _ = xy
    xs = ["a", "b", "c"]
    v = VectorAssembler(inputCols=xs, outputCol="f").transform(df)
    ml = LinearRegression(featuresCol="f", labelCol="y", solver="normal", regParam=0.0).fit(v)
    fit = M.ols(df, xs, "y")
    np.testing.assert_allclose(ml.coefficients.toArray(), fit.coef, rtol=1e-8)
    assert abs(ml.intercept - fit.intercept) < 1e-8
    las_ml = LinearRegression(featuresCol="f", labelCol="y", regParam=0.1, elasticNetParam=1.0,
                              standardization=False, tol=1e-12, maxIter=1000).fit(v)
    las = M.lasso(df, xs, "y", 0.1, fit.gram)
    np.testing.assert_allclose(las_ml.coefficients.toArray(), las.coef, atol=1e-6)


def test_kth_smallest_radix_select(spark):
    import hashlib
    vals = [hashlib.md5(str(i).encode()).hexdigest() for i in range(3000)]
    vals += ["00" + "a" * 30] * 5          # a hot prefix
    df = spark.createDataFrame([(v,) for v in vals], "h string")
    srt = sorted(vals)
    for k in (1, 3, 6, 50, 1500, len(vals)):
        assert M.kth_smallest_hex(df, "h", k, step=1, fetch_max=4) == srt[k - 1]


def test_quantiles_select_skewed_and_duplicates(spark):
    rng = np.random.default_rng(11)
    vals = np.concatenate([rng.lognormal(0, 3, 3000), np.full(500, 7.0), [1e12, -1e9]])
    df = spark.createDataFrame([(float(v), "g" + str(i % 2)) for i, v in enumerate(vals)], "x double, g string")
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = ST.quantiles(df, ["x"], probs, method="select").first()
    exp = np.percentile(vals, [p * 100 for p in probs])
    np.testing.assert_allclose([got[ST._pname(p)] for p in probs], exp, rtol=1e-12)
    byg = ST.quantiles(df, ["x"], [0.5], by=["g"], method="select").toPandas().set_index("g")
    for g in ("g0", "g1"):
        sub = vals[np.arange(len(vals)) % 2 == int(g[1])]
        assert abs(byg.loc[g, "q50"] - np.percentile(sub, 50)) <= 1e-12 * abs(np.percentile(sub, 50))


def test_selection_moves_no_values_by_digit(spark, monkeypatch):
    """The open ranges are broadcast: a shuffle by digit brings all values of a wanted one to one task."""
    from tidemark.operators import select
    plans, real = [], select.cut_lineage
    monkeypatch.setattr(select, "cut_lineage", lambda d: plans.append(d._jdf.queryExecution().executedPlan().toString()) or real(d))
    df = spark.range(3000).selectExpr("1e6 + id / 3 AS x", "id % 3 AS g")
    whole, groups = ST.quantiles(df, ["x"], [0.25]).collect(), ST.quantiles(df, ["x"], [0.25], by=["g"]).collect()
    assert any("Join" in p for p in plans) and not any("SortMergeJoin" in p for p in plans)
    assert abs(whole[0].q25 - (1e6 + 2999 * 0.25 / 3)) < 1e-6
    monkeypatch.setattr(select, "SMALL", 0)
    assert ST.quantiles(df, ["x"], [0.25]).collect() == whole
    assert sorted(ST.quantiles(df, ["x"], [0.25], by=["g"]).collect()) == sorted(groups)


def test_scalers_all_null_column(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, None)], "x double, z double")
    for fit in (SC.fit_minmax, SC.fit_standard):
        out = fit(df, ["x", "z"]).apply(df).toPandas()
        assert out.z.isna().all() and out.x.notna().all()


def test_wide_correlations_read_rows_once(spark):
    """One pass, with the sums of very unequal parts, and a projection that isn't one long method."""
    rng = np.random.default_rng(5)
    vals = rng.normal(size=(400, 26)) + rng.normal(0, 1e6, 26)
    vals[rng.random(vals.shape) < 0.2] = np.nan
    vals[:, 3] = np.where(np.isnan(vals[:, 3]), np.nan, 0.1)
    vals[:, 4] = np.nan
    vals[0, 5] = np.inf
    read = spark.sparkContext.accumulator(0)
    names = [f"c{k}" for k in range(26)]

    def count(batches):
        for b in batches:
            read.add(len(b))
            yield b

    df = spark.createDataFrame([(*map(float, r),) for r in vals], ", ".join(f"{c} double" for c in names)).repartition(5)
    got = {(r.var_x, r.var_y): r.pearson_r for r in ST.corr_long(df.mapInPandas(count, df.schema), names).collect()}
    assert read.value == 400
    exp = pd.DataFrame(vals, columns=names).corr()
    for (a, b), r in got.items():
        assert r is None if {a, b} & {"c3", "c4", "c5"} else abs(r - exp.loc[a, b]) < 1e-9
    with pytest.raises(ValueError):
        wide.moments(df.fillna(0.0), names)
