"""Answers that must not depend on input size, units, zone or malformed text."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import clean as CL
from tidemark.operators import align as AL
from tidemark.operators import models as M
from tidemark.operators import scale as SC
from tidemark.operators import stats as ST
from tidemark.session import materialize_if_derived
from tidemark.sources import delimited


@pytest.fixture
def grouped(spark):
    rows = [(None if i % 3 == 0 else "ab"[i % 2], i, float(i) if i % 4 else None) for i in range(60)]
    return spark.createDataFrame(rows, "g string, k long, v double")


@pytest.mark.parametrize("op", [
    lambda d, b: AL.fill_forward(d, "k", by=["g"], buckets=b),
    lambda d, b: AL.fill_backward(d, "k", by=["g"], buckets=b),
    lambda d, b: AL.fill_both(d, "k", by=["g"], buckets=b),
    lambda d, b: AL.pct_change(d, "k", by=["g"], buckets=b),
    lambda d, b: M.global_rank(d, "k", by=["g"], buckets=b),
    lambda d, b: ST.quantiles(d, ["v"], [0.1, 0.5], by=["g"], method="rank", buckets=b),
    lambda d, b: AL.asof_nearest(d, d.where("k % 5 = 1").select("g", "k", F.col("v").alias("w")), "k", by=["g"], buckets=b),
])
def test_many_buckets_equal_one(grouped, op):
    one, many = (sorted(map(repr, op(grouped, b).collect())) for b in (1, 9))
    assert one == many and any("g=None" in r for r in many)


def test_quantile_methods_agree_on_null_groups_and_nan(spark):
    rows = [(None, 1.0), (None, 2.0), (None, float("nan")), ("a", 3.0), ("a", None), ("a", 5.0), ("a", 5.0)]
    d = spark.createDataFrame(rows, "g string, v double")
    got = [sorted(map(repr, ST.quantiles(d, ["v"], [0.5], by=["g"], method=m).collect())) for m in ("select", "rank", "percentile")]
    assert got[0] == got[1] == got[2] and "q50=1.5" in got[0][0] + got[0][1]


def test_many_bounds_are_looked_up(spark):
    bounds = [float(b) for b in range(0, 3000, 3)]
    d = spark.createDataFrame([(float(x),) for x in range(-5, 3010, 7)] + [(None,)], "x double")
    for r in d.select("x", AL.bucket_of(F.col("x"), bounds).alias("b")).collect():
        assert r.b == (0 if r.x is None else sum(b <= r.x for b in bounds))


def test_full_outer_keeps_duplicates_or_says_so(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "k int, a string")
    b = spark.createDataFrame([(1, "p"), (3, "q")], "k int, b string")
    assert AL.full_outer_on([a, b], "k").count() == 4
    with pytest.raises(Exception, match="twice"):
        AL.full_outer_on([a, b], "k", unique_keys=True).collect()


def test_wall_clock_keys_keep_their_order_in_any_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        times = [dt.datetime(2024, 3, 10, h, m, 0, 250000) for h in range(5) for m in (15, 45)]
        d = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz")
        got = [r.k for r in d.select("t", AL.numeric_key(d, "t").alias("k")).orderBy("t").collect()]
        assert np.diff(got).tolist() == [1_800_000_000] * 9
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_features_of_very_different_units(spark):
    rng = np.random.default_rng(0)
    x = np.column_stack([rng.normal(size=300) * 1e9, rng.normal(size=300) * 1e-4])
    y = 2e-9 * x[:, 0] + 5000 * x[:, 1] + rng.normal(size=300) * 0.01
    d = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, y double")
    want = np.linalg.lstsq(np.column_stack([np.ones(300), x / [1e9, 1e-4]]), y, rcond=None)[0][1:] / [1e9, 1e-4]
    np.testing.assert_allclose(M.ols(d, ["a", "b"], "y").coef, want, rtol=1e-6)
    assert all(1 <= v < 1.1 for _, v in M.vif(d, ["a", "b"], constant=False))


def test_scores_use_complete_rows(spark):
    d = spark.createDataFrame([(float(i), 2.0 * i + (i % 3), i) for i in range(20)] + [(None, 900.0, 99)], "x double, y double, k long")
    fit = M.ols(d.where("x is not null"), ["x"], "y")
    with_null, without = (M.scores(s, [fit], "y").first() for s in (d, d.where("x is not null")))
    assert with_null == without
    g = M.gram_by(d.withColumn("t", F.col("k") % 2 == 0), ["x"], "y", "t")
    np.testing.assert_allclose(M.gram_scores(fit, M.pooled(list(g.values()))), (without.mse, without.r2), rtol=1e-9)
    c, s = {"x": 3.0}, {"x": 2.5}
    scaled = M.ols(None, ["x"], "y", M.rescaled(g[True], c, s))
    np.testing.assert_allclose(scaled.coef[0] / 2.5, M.ols(None, ["x"], "y", g[True]).coef[0])


def test_perfect_fit(spark):
    d = spark.createDataFrame([(float(i), 4.0 * i) for i in range(30)], "x double, y double")
    r = ST.linregress(d, "x", "y").first()
    assert r.rvalue == 1.0 and r.pvalue == 0.0
    zero = spark.createDataFrame([(float(i), 0.0) for i in range(30)], "x double, y double")
    assert math.isinf(M.ols_summary(zero, ["x"], "y").stats["log_likelihood"])


def test_robust_scaling_of_an_empty_column(spark):
    d = spark.createDataFrame([(1.0, None), (2.0, None), (4.0, None)], "a double, b double")
    rows = SC.fit_robust(d, ["a", "b"]).apply(d).collect()
    assert [r.b for r in rows] == [None] * 3 and rows[1].a == 0.0


@pytest.mark.parametrize("text, want", [
    ("12", 12.0), (" 1.5 ", 1.5), ("1.", 1.0), (".5", 0.5), ("-2e3", -2000.0), ("NaN", None), ("1d", None), ("12f", None),
    ("0x1p3", None), ("1,200", None), ("", None), ("inf", math.inf), (None, None)])
def test_numbers(spark, text, want):
    d = spark.createDataFrame([(text,)], "t string")
    assert d.select(CL.to_number("t").alias("x")).first().x == want


def test_quoted_line_ends(spark, tmp_path):
    (tmp_path / "f.csv").write_text('preamble\nk,v\n"a\nb",100\r\n"c, ""d""",200\n\nlast,300', newline="")
    rows = delimited.read_with_preamble(spark, str(tmp_path / "f.csv"), 1, ["k", "v"]).orderBy("line_no").collect()
    assert [(r.k, r.v) for r in rows][0] == ("a\nb", "100") and [r.v for r in rows] == ["100", "200", "300"]


def test_only_costly_plans_are_materialised(spark):
    plain = spark.range(5).withColumn("Join_Window", F.col("id") + 1)
    assert materialize_if_derived(plain) is plain
    derived = plain.select(F.explode(F.array("id", "Join_Window")).alias("x"))
    assert materialize_if_derived(derived) is not derived
