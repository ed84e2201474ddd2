"""Matrix products of many columns, dependent designs, resampled bands, the lasso's gap, tails."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import dist
from tidemark.operators import models as M
from tidemark.operators import stats as ST
from tidemark.operators import wide


@pytest.fixture(scope="module")
def many(spark):
    """30 columns with gaps (null and NaN), one constant, one empty, one with an infinite value."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 30)) @ rng.normal(size=(30, 30)) + 1e6
    x[:, 4] = 5.0
    rows = [tuple(None if (i + k) % 11 == 0 else float("nan") if (i + k) % 13 == 0 else float(v) for k, v in enumerate(r)) for i, r in enumerate(x)]
    rows = [(*r[:5], None, *r[6:]) for r in rows]
    cols = [f"v{k}" for k in range(30)]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)).repartition(5), cols


def test_wide_correlation_equals_pairs(many, monkeypatch):
    df, cols = many
    shown = lambda d: {(r.var_x, r.var_y): r.pearson_r for r in d.collect()}
    got = shown(ST.corr_long(df, cols))
    monkeypatch.setattr(wide, "WIDE", 1000)
    want = shown(ST.corr_long(df, cols))
    assert set(got) == set(want) and len(got) == 900
    assert all((got[k] is None) == (want[k] is None) and (want[k] is None or abs(got[k] - want[k]) < 1e-9) for k in want)
    assert got["v4", "v0"] is None and got["v5", "v5"] is None


def test_infinite_columns_lose_their_own_pairs_only(spark, monkeypatch):
    monkeypatch.setattr(wide, "WIDE", 2)
    df = spark.createDataFrame([(1.0, float("inf"), 2.0), (2.0, 1.0, 4.5), (3.0, 0.0, 6.0)], "a double, b double, c double")
    got = {(r.var_x, r.var_y): r.pearson_r for r in ST.corr_long(df, ["a", "b", "c"]).collect()}
    assert got["a", "b"] is None and got["b", "b"] is None and got["a", "c"] > 0.98
    with pytest.raises(ValueError, match="infinite"):
        M.gram(df, ["a", "b"], "c")
    empty = ST.corr_long(df.where("a > 9"), ["a", "b", "c"]).collect()
    assert all(r.pearson_r is None for r in empty)


def test_wide_gram_equals_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 200)) * rng.uniform(0.1, 100, 200) + 1e4
    y = x @ rng.normal(size=200)
    cols = [f"v{k}" for k in range(200)]
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)] + [(None, *[1.0] * 200)],
                               ", ".join(f"{c} double" for c in cols) + ", y double")
    g = M.gram(df, cols, "y")
    centred = x - x.mean(0)
    assert g.n == 500
    np.testing.assert_allclose(g.Sxx, centred.T @ centred, rtol=1e-9, atol=1e-6 * np.abs(g.Sxx).max())
    np.testing.assert_allclose(g.Sxy, centred.T @ (y - y.mean()), rtol=1e-7, atol=1e-7 * np.abs(g.Sxy).max())
    np.testing.assert_allclose(g.xbar, x.mean(0))


def test_dependent_designs(spark):
    rng = np.random.default_rng(4)
    a, c = rng.normal(size=200), rng.normal(size=200) + 3
    rows = [(float(x), float(2 * x), float(z), 7.0, float(x + z + 1)) for x, z in zip(a, c)]
    df = spark.createDataFrame(rows, "a double, a2 double, c double, k double, s double")
    free = dict(M.vif(df, ["a", "c"]))
    got = dict(M.vif(df, ["a", "a2", "c"]))
    assert got["a"] == got["a2"] == math.inf and abs(got["c"] - free["c"]) < 1e-9 and abs(got["const"] - free["const"]) < 1e-6
    got = dict(M.vif(df, ["a", "k", "c"]))
    assert got["k"] == got["const"] == math.inf and abs(got["a"] - free["a"]) < 1e-9
    got = dict(M.vif(df, ["a", "c", "s"]))       # s = a + c + 1: all three depend on each other and make the constant
    assert all(v == math.inf for v in got.values())
    got = dict(M.vif(df, ["a", "k", "c"], constant=False))
    assert all(math.isfinite(v) for v in got.values())
    got = dict(M.vif(df, ["a", "a2", "c"], constant=False))
    assert got["a"] == got["a2"] == math.inf and abs(got["c"] - dict(M.vif(df, ["a", "c"], constant=False))["c"]) < 1e-9


def test_bootstrap_band(spark):
    rng = np.random.default_rng(6)
    x = rng.uniform(0, 10, 400)
    y = 2 * x + 1 + rng.normal(size=400)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))] + [(999, None, 1.0), (998, 2.0, float("nan"))],
                               "k long, x double, y double")
    one = [tuple(r) for r in M.bootstrap_band(df.repartition(7), "x", "y", "k", points=5, n_boot=300).orderBy("i").collect()]
    two = [tuple(r) for r in M.bootstrap_band(df.repartition(2), "x", "y", "k", points=5, n_boot=300).orderBy("i").collect()]
    np.testing.assert_allclose(one, two, rtol=1e-9)
    exact = [(r.lo, r.hi) for r in M.reg_band(df, "x", "y", points=5).orderBy("x").collect()]
    for (_, _, fit, lo, hi), (low, high) in zip(one, exact):
        assert lo < fit < hi and abs((hi - lo) / (high - low) - 1) < 0.25
    fits = M.bootstrap_fits(df, "x", "y", "k", 801)
    assert fits.count() == 801 and abs(fits.agg(F.avg("slope")).first()[0] - 2) < 0.05
    same = spark.createDataFrame([(1, 3.0, 1.0), (2, 3.0, 2.0)], "k long, x double, y double")
    assert M.bootstrap_fits(same, "x", "y", "k", 20).collect() == []


def test_poisson_weights():
    cuts = [0, *M.poisson_cuts(), 1 << 16]
    share = np.diff(cuts) / (1 << 16)
    assert all(abs(s - math.exp(-1) / math.factorial(k)) < 2e-5 for k, s in enumerate(share))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 6), st.floats(1e-3, 2.0), st.integers(0, 2**31))
def test_lasso_gap_bounds_the_objective(p, alpha, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(40, p)) @ rng.normal(size=(p, p))
    y = x @ rng.normal(size=p) + rng.normal(size=40)
    xc, yc = x - x.mean(0), y - y.mean()
    g = M.Gram([f"x{k}" for k in range(p)], "y", 40, x.mean(0), float(y.mean()), xc.T @ xc, xc.T @ yc, float(yc @ yc))
    value = lambda w: ((yc - xc @ w) ** 2).sum() / 80 + alpha * np.abs(w).sum()
    fit = M.lasso(None, g.xs, "y", alpha, g)
    best = value(fit.coef)
    assert M.duality_gap(g, fit.coef, alpha) <= 1e-9 * (1 + g.Syy / g.n)
    for w in (np.zeros(p), rng.normal(size=p), fit.coef + rng.normal(size=p) * 0.01):
        assert value(w) - best <= M.duality_gap(g, w, alpha) + 1e-9 * (1 + value(w)) and value(w) >= best - 1e-9 * (1 + best)
    pull = (g.Sxy - g.Sxx @ fit.coef) / g.n
    assert (np.abs(pull) <= alpha + 1e-6 * (1 + alpha)).all()


def test_tails_of_any_degrees_of_freedom(spark):
    normal = lambda z: 0.5 * math.erfc(z / math.sqrt(2))
    for z in (-2.0, 0.0, 0.3, 1.7, 3.0, 8.0):
        assert abs(dist.t_sf(z, 1e13) / normal(z) - 1) < 1e-9
        assert abs(dist.t_sf(z, 1) - (0.5 - math.atan(z) / math.pi)) < 1e-14
        assert abs(dist.t_sf(z, 2) - (0.5 - z / (2 * math.sqrt(2 + z * z)))) < 1e-14
    assert abs(dist.f_sf(2.5, 2, 7) - (1 + 2 * 2.5 / 7) ** -3.5) < 1e-14
    assert dist.t_sf(math.inf, 5) == 0 and math.isnan(dist.t_sf(1.0, 0)) and math.isnan(dist.t_ppf(0.9, 0))
    rows = [(t, n) for t in (-3.0, 0.0, 0.5, 1.8, 40.0, math.inf) for n in (1.0, 2.0, 361.0, 1e7, 1e12)] + [(1.0, 0.0), (None, 3.0)]
    df = spark.createDataFrame(rows, "t double, n double")
    got = df.select("t", "n", dist.t_sf_col(F.col("t"), F.col("n")).alias("p"), dist.f_sf_col(F.abs("t"), F.lit(3.0), F.col("n")).alias("f"))
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    for r in got.collect():
        if r.t is None or r.n == 0:
            assert r.p is None
        else:
            assert abs(r.p - dist.t_sf(r.t, r.n)) <= 1e-12 * r.p and abs(r.f - dist.f_sf(abs(r.t), 3.0, r.n)) <= 1e-12 * r.f
