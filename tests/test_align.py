"""Ordered operators: fills, percentage change, nearest join, first match — on hand-made
edge rows and, with many buckets forced, against brute force on a driver table."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import align as AL

D = dt.date


def _rates(spark):
    rows = [(D(2024, 1, 1), None, 1.0), (D(2024, 1, 2), 2.0, None), (D(2024, 1, 3), None, None),
            (D(2024, 1, 4), 4.0, 3.0), (D(2024, 1, 5), None, None)]
    return spark.createDataFrame(rows, "Date date, a double, b double")


def _pd_fill(pdf, cols):
    return pdf.sort_values("Date").set_index("Date")[cols].ffill().bfill()


@pytest.mark.parametrize("force", [False, True])
def test_fill_leading_middle_trailing(spark, monkeypatch, force):
    if force:
        monkeypatch.setattr(AL, "ROWS_PER_BUCKET", 2)
    df = _rates(spark)
    got = AL.fill_both(df, "Date").orderBy("Date").toPandas().set_index("Date")
    exp = _pd_fill(df.toPandas(), ["a", "b"])
    assert got["a"].tolist() == exp["a"].tolist() == [2.0, 2.0, 2.0, 4.0, 4.0]
    assert got["b"].tolist() == exp["b"].tolist() == [1.0, 1.0, 1.0, 3.0, 3.0]
    ff = AL.fill_forward(df, "Date").orderBy("Date").toPandas()
    assert ff["a"].isna().tolist() == [True, False, False, False, False]
    bf = AL.fill_backward(df, "Date").orderBy("Date").toPandas()
    assert bf["a"].tolist()[:4] == [2.0, 2.0, 4.0, 4.0] and pd.isna(bf["a"].iloc[4])


def test_fill_many_buckets_matches_pandas(spark, many_buckets):
    from tidemark.plans import tables as TB
    df = TB.rates_wide(spark, "/root/testdata/sf0.001")
    got = AL.fill_both(df, "Date").toPandas().sort_values("Date").set_index("Date")
    exp = _pd_fill(df.toPandas(), ["CNY_JPY", "PHP_JPY", "VND_JPY"])
    pd.testing.assert_frame_equal(got[exp.columns], exp, check_names=False)


def test_fill_by_groups(spark, many_buckets):
    rows = [("x", 1, None), ("x", 2, 5.0), ("x", 3, None), ("y", 1, 7.0), ("y", 2, None)]
    df = spark.createDataFrame(rows, "k string, t int, v double")
    got = {(r.k, r.t): r.v for r in AL.fill_forward(df, "t", ["v"], by=["k"]).collect()}
    assert got == {("x", 1): None, ("x", 2): 5.0, ("x", 3): 5.0, ("y", 1): 7.0, ("y", 2): 7.0}


def test_pct_change_pads_and_zero(spark):
    rows = [(1, 10.0), (2, None), (3, 20.0), (4, 0.0), (5, 5.0)]
    df = spark.createDataFrame(rows, "t int, v double")
    got = AL.pct_change(df, "t", ["v"], scale=1.0).orderBy("t").toPandas()["v"].tolist()
    # pandas: [nan, 0.0, 1.0, -1.0, inf]; a zero denominator is null here
    assert pd.isna(got[0]) and got[1] == 0.0 and got[2] == 1.0 and got[3] == -1.0 and pd.isna(got[4])
    z = AL.pct_change(df, "t", ["v"], scale=1.0, first_zero=True).orderBy("t").toPandas()["v"]
    assert z.iloc[0] == 0.0 and z.iloc[4] == 0.0


def test_pct_change_many_buckets(spark, many_buckets):
    from tidemark.plans import tables as TB
    df = TB.rates_wide(spark, "/root/testdata/sf0.001")
    got = AL.pct_change(df, "Date", ["CNY_JPY"]).toPandas().sort_values("Date")["CNY_JPY"]
    exp = df.toPandas().sort_values("Date")["CNY_JPY"].ffill()
    exp = (exp / exp.shift(1) - 1) * 100
    np.testing.assert_allclose(got.to_numpy(float), exp.to_numpy(float), equal_nan=True)


def test_nearest_exact_before_after_tie(spark):
    right = spark.createDataFrame([(D(2024, 1, 10), "a"), (D(2024, 1, 14), "b"), (D(2024, 1, 20), None)],
                                  "Date date, v string")
    left = spark.createDataFrame([(1, D(2024, 1, 14)), (2, D(2024, 1, 1)), (3, D(2024, 2, 1)),
                                  (4, D(2024, 1, 12)), (5, D(2024, 1, 19)), (6, None)],
                                 "id int, Date date")
    got = {r.id: (r.v, r.m) for r in AL.asof_nearest(left, right, "Date", matched_as="m").collect()}
    assert got[1] == ("b", D(2024, 1, 14))      # exact
    assert got[2] == ("a", D(2024, 1, 10))      # before the first
    assert got[3] == (None, D(2024, 1, 20))     # after the last; null payload still matches
    assert got[4] == ("a", D(2024, 1, 10))      # tie → earlier
    assert got[5] == (None, D(2024, 1, 20))
    assert got[6] == (None, None)               # null key


def test_nearest_many_buckets_brute_force(spark, many_buckets):
    from tidemark.plans import tables as TB
    sf = "/root/testdata/sf0.001"
    left = TB.daily_price(spark, sf)
    right = TB.rates_wide(spark, sf)
    got = AL.asof_nearest(left, right, "Date", matched_as="m").toPandas().set_index("Date")["m"]
    rd = np.array(sorted(right.toPandas()["Date"]), dtype="datetime64[D]")
    for d, m in got.items():
        diff = np.abs(rd - np.datetime64(d, "D")).astype(int)
        best = rd[np.argmin(diff)]   # first minimum = earlier date on ties
        assert np.datetime64(m, "D") == best


def test_first_match_takes_first_file(spark):
    right = spark.createDataFrame([(2020, 1, "b.csv", 1.0), (2020, 1, "a.csv", 2.0), (2020, 2, "c.csv", 3.0)],
                                  "year int, month int, file string, g double")
    left = spark.createDataFrame([(2020, 1), (2020, 3)], "year int, month int")
    got = {(r.year, r.month): r.g for r in
           AL.first_match(left, right, ["year", "month"], ["g"], order="file").collect()}
    assert got == {(2020, 1): 2.0, (2020, 3): None}
    z = {(r.year, r.month): r.g for r in
         AL.first_match(left, right, ["year", "month"], ["g"], order="file", default=0.0).collect()}
    assert z == {(2020, 1): 2.0, (2020, 3): 0.0}


def test_full_outer_on_union_equals_joins(spark):
    a = spark.createDataFrame([(1, 1.0), (2, None)], "k int, a double")
    b = spark.createDataFrame([(2, 5.0), (3, 6.0)], "k int, b double")
    u = sorted(AL.full_outer_on([a, b], "k", unique_keys=True).collect())
    j = sorted(AL.full_outer_on([a, b], "k", unique_keys=False).select("k", "a", "b").collect())
    assert u == j


def test_nearest_numeric_keys_many_buckets(spark, many_buckets):
    """Non-date keys take the distinct-left-keys path with bucket carries."""
    rng = np.random.default_rng(3)
    rk = sorted(set(rng.integers(0, 500, 60).tolist()))
    lk = rng.integers(-20, 520, 200).tolist()
    right = spark.createDataFrame([(int(k), f"v{k}") for k in rk], "k long, v string")
    left = spark.createDataFrame([(i, int(k)) for i, k in enumerate(lk)], "id long, k long")
    got = {r.id: r.m for r in AL.asof_nearest(left, right, "k", matched_as="m").collect()}
    arr = np.array(rk)
    for i, k in enumerate(lk):
        assert got[i] == arr[np.argmin(np.abs(arr - k))]  # first minimum = smaller key on ties


def test_bucket_of_matches_bisect(spark):
    import bisect
    bounds = [1.0, 2.0, 2.5, 7.0, 10.0, 11.0, 50.0]
    xs = [-3.0, 1.0, 1.5, 2.0, 2.4, 2.5, 6.9, 7.0, 10.5, 11.0, 49.0, 50.0, 99.0, None]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in df.select(AL.bucket_of(F.col("x"), bounds)).collect()]
    assert got == [bisect.bisect_right(bounds, x) if x is not None else 0 for x in xs]


def test_a_hot_key_is_split_over_buckets(spark):
    """Half of the left rows share one key: its buckets get about equal parts, and every row its nearest."""
    left = spark.range(4000).select("id", F.when(F.col("id") % 2 == 0, F.lit(500.0)).otherwise(F.col("id").cast("double") / 4).alias("k"))
    right = spark.createDataFrame([(float(x), f"r{x}") for x in (-5, 100, 100.25, 499, 500, 501, 990)], "k double, m string")
    u = left.select(F.col("k").alias(AL._K), F.lit(1).alias(AL._SIDE), F.struct("id").alias("_tm_row"))
    b, n = AL._merge_buckets(u, F.xxhash64(F.to_json("_tm_row")), 16)
    sizes = {r[AL._B]: r["count"] for r in b.groupBy(AL._B).count().collect()}
    assert n == 16 and max(sizes.values()) < 500
    keys = [x for x in (-5, 100, 100.25, 499, 500, 501, 990)]
    want = {i: f"r{min(keys, key=lambda x: (abs(x - k), x))}" for i, k in ((r.id, r.k) for r in left.collect())}
    for buckets in (1, 16):
        got = {r.id: r.m for r in AL.asof_nearest(left, right, "k", buckets=buckets).collect()}
        assert got == want
    # without the shared key's own right row its neighbours on both sides are carried over all of its buckets
    got = {r.id: r.m for r in AL.asof_nearest(left, right.where("k <> 500"), "k", buckets=16).collect()}
    assert {got[i] for i in range(0, 4000, 2)} == {"r499"}


def test_backward_fill_of_a_large_bucket_is_linear(spark):
    """Only the last row has a value: a frame that is gone through again for every row would take minutes."""
    import time
    n = 300_000
    d = spark.range(n).select(F.col("id").alias("k"), F.when(F.col("id") == n - 1, F.lit(7.0)).alias("v"))
    begun = time.perf_counter()
    assert AL.fill_backward(d, "k", ["v"], buckets=1).where("v = 7").count() == n
    assert time.perf_counter() - begun < 30
