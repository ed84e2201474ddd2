"""NaN is missing everywhere, infinities and extreme numbers have defined answers."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import clean as CL
from tidemark.operators import align as AL
from tidemark.operators import models as M
from tidemark.operators import scale as SC
from tidemark.operators import select as SEL
from tidemark.operators import stats as ST

NAN, INF = float("nan"), float("inf")


def test_first_digit_never_falls(spark):
    values = [0.0, -0.0, INF, -INF, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308]
    for e in range(-1074, 1024):
        v = 2.0 ** e
        values += [v, -v, float(np.nextafter(v, INF)), float(np.nextafter(v, 0))]
    rng = np.random.default_rng(0)
    values += [x for x in rng.integers(0, 2**64, 20000, dtype=np.uint64).view(np.float64).tolist() if x == x]
    df = spark.createDataFrame([(v,) for v in values], "value double")
    rows = sorted((r.value, r.d) for r in df.select("value", SEL.first_digit("value").alias("d")).collect())
    digits = [d for _, d in rows]
    assert digits == sorted(digits) and max(map(abs, digits)) <= 1 << 20
    assert [d for v, d in rows if v == 0] == [0, 0] + [0] * (sum(v == 0 for v in values) - 2)


@pytest.mark.parametrize("values", [
    [1.0], [INF], [-INF, INF], [NAN, None], [5e-324, 1e-323, 0.0, -5e-324], [1.7e308, -1.7e308, 1.0], [3.0] * 50 + [INF] * 2,
    np.random.default_rng(5).lognormal(0, 50, 800).tolist(), [float(x) for x in range(-300, 300)],
])
@pytest.mark.parametrize("cells", [1 << 22, 3])
def test_selection_of_any_values(spark, monkeypatch, values, cells):
    monkeypatch.setattr(SEL, "CELLS", cells)
    df = spark.createDataFrame([(v,) for v in values] * 2, "v double")
    got = ST.quantiles(df, ["v"], [0.0, 0.3, 0.5, 1.0]).collect()
    own = sorted(v for v in values * 2 if v is not None and v == v)
    assert len(got) == bool(own)
    for name, p in zip(("q0", "q30", "q50", "q100"), (0.0, 0.3, 0.5, 1.0)) if own else ():
        h = (len(own) - 1) * p
        lo, hi, s = own[math.floor(h)], own[math.ceil(h)], h - math.floor(h)
        want = lo if lo == hi or s == 0 else lo + (hi - lo) * s if math.isfinite(hi - lo) else lo * (1 - s) + hi * s
        assert got[0][name] == want if want == want else got[0][name] is None
    assert not own or got[0]["n"] == len(own)


def test_an_infinite_value_takes_a_few_jobs(spark):
    df = spark.range(6000).select(F.when(F.col("id") == 7, F.lit(INF)).otherwise(F.rand(3)).alias("v")).persist()
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("one-inf", "quantiles")
    q = ST.quantiles(df, ["v"], [0.25, 1.0]).first()
    spark.sparkContext.setJobGroup("", "")
    assert q["q100"] == INF and 0 < q["q25"] < 1 and len(tracker.getJobIdsForGroup("one-inf")) < 40


@pytest.fixture
def gappy(spark):
    rows = [(i, float(i * i % 17) if i % 4 else None, float(i % 5)) for i in range(40)]
    null = spark.createDataFrame(rows, "k long, x double, y double")
    return null, null.withColumn("x", F.coalesce("x", F.lit(NAN)))


@pytest.mark.parametrize("op", [
    lambda d: ST.box_stats(d, "x"), lambda d: ST.box_stats(d, "x", by=["y"]), lambda d: ST.iqr_bounds(d, "x", k=0.2).drop("n", "outlier_pct"),
    lambda d: ST.histogram(d, "x"), lambda d: ST.kde_grid(d, "x", 20), lambda d: ST.corr_long(d, ["x", "y"]),
    lambda d: ST.linregress(d, "x", "y"), lambda d: ST.polyfit_per_feature(d, ["x"], "y"), lambda d: ST.describe(d, ["x"]),
    lambda d: ST.mean_by(d, ["y"], ["x"]), lambda d: ST.mean_count_by(d, "y", "x"), lambda d: ST.global_summary(d, "x"),
    lambda d: M.ols(d, ["x"], "y").coef_df(d.sparkSession), lambda d: M.qq_pairs(d, "x", "k"), lambda d: M.pair_bins(d, ["x", "y"], 4),
    lambda d: M.vif_df(d.sparkSession, M.vif(d, ["x", "y"])), lambda d: SC.fit_minmax(d, ["x"]).to_df(d.sparkSession),
    lambda d: SC.fit_standard(d, ["x"]).to_df(d.sparkSession), lambda d: SC.fit_robust(d, ["x"]).to_df(d.sparkSession),
    lambda d: AL.fill_both(d, "k", ["x"]), lambda d: AL.pct_change(d, "k", ["x"]), lambda d: CL.drop_nulls(d, ["x"]), lambda d: CL.fill_zero(d, ["x"]),
])
def test_nan_counts_as_null(gappy, op):
    shown = lambda d: sorted(repr([round(v, 9) if isinstance(v, float) else v for v in r]) for r in op(d).collect())
    null, nan = gappy
    assert shown(null) == shown(nan) and "nan" not in "".join(shown(nan))


def test_infinite_values(spark):
    d = spark.createDataFrame([(1.0, 1.0), (2.0, INF), (3.0, 5.0), (4.0, 2.0)], "x double, y double")
    assert ST.corr_long(d, ["x", "y"]).where("var_x <> var_y").first().pearson_r is None
    for raises in (lambda: ST.histogram(d, "y"), lambda: ST.kde_grid(d, "y"), lambda: M.ols(d, ["y"], "x")):
        with pytest.raises(ValueError, match="infinite"):
            raises()
    assert ST.box_stats(d, "y").first().q3 == INF
    clipped = d.union(spark.createDataFrame([(NAN, NAN)], d.schema)).select(CL.clip_col("y", 2.0, 4.0).alias("y")).collect()
    assert [r.y for r in clipped][:4] == [2.0, 4.0, 4.0, 2.0] and math.isnan(clipped[4].y)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(-1e3, 1e3), min_size=3, max_size=60), st.integers(1, 40))
def test_fast_gauss_transform_equals_the_sum(spark, values, size):
    d = spark.createDataFrame([(v,) for v in values], "v double")
    got = sorted((r.i, r.x, r.density) for r in ST.kde_grid(d, "v", size).collect())
    sd = np.std(values, ddof=1)
    if sd == 0:
        assert got == []
        return
    h = sd * len(values) ** -0.2
    assert len(got) == size
    for _, x, density in got:
        want = np.exp(-0.5 * ((x - np.array(values)) / h) ** 2).sum() / (len(values) * h * math.sqrt(2 * math.pi))
        assert abs(density - want) <= 1e-12 / h


def test_density_far_from_the_data(spark):
    """One value far off: most grid points are out of every box's reach."""
    values = [0.0, 1.0, 2.0] * 2000 + [1e6]
    k = ST.kde_grid(spark.createDataFrame([(v,) for v in values], "v double"), "v", 1000, bw=0.5).orderBy("i").collect()
    assert len(k) == 1000 and k[0].density > 0.1 and k[500].density == 0.0 and k[999].density > 0
    assert not any("Python" in n or "Arrow" in n for n in ST.kde_grid(
        spark.createDataFrame([(v,) for v in values], "v double"), "v")._jdf.queryExecution().executedPlan().toString().split())
