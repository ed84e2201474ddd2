"""Descriptive statistics and simple fits.

Every function is one or a few aggregations; what returns to the driver is bounded
(a feature-by-feature matrix, a few quantile bounds).  Exact quantiles have these
strategies:

* ``method="select"`` (what ``auto`` takes, for any values and any number of groups) —
  selection by digits (``select``): each of at most four passes is an aggregation; values are never
  shuffled or sorted.
* ``method="rank"`` — values are bucketed by range, ranked inside each bucket, given global
  ranks from per-bucket counts, and only the two order statistics around each requested
  position are kept.  No group's values are ever gathered in one place.
* ``method="percentile"`` — Spark's exact ``percentile`` aggregate.  It keeps a
  value→count map per group, so it is meant for tables whose size is bounded by
  construction (a daily panel: one row per day).
* ``method="approx"`` — ``percentile_approx`` for when exactness is not needed.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import clip_col, nan_to_null
from .align import _B, _as_list, null_safe_join, range_buckets
from . import wide
from .select import NUMBER, between, select_quantiles

# ---------------------------------------------------------------------------
# A1-A6 grouped and global means


def mean_by(df: DataFrame, keys, cols, drop_null_keys: bool = True) -> DataFrame:
    """A1/A2: mean of ``cols`` per key (pandas drops null group keys)."""
    keys = _as_list(keys)
    src = nan_to_null(df, _as_list(cols))
    if drop_null_keys:
        for k in keys:
            src = src.where(F.col(k).isNotNull())
    return src.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in _as_list(cols)])


def mean_count_by(df: DataFrame, key, col: str) -> DataFrame:
    """A3: mean and non-null count of ``col`` per key."""
    return (nan_to_null(df, [col]).where(F.col(key).isNotNull()).groupBy(key)
            .agg(F.avg(col).alias("mean"), F.count(col).alias("count")))


def global_summary(df: DataFrame, col: str) -> DataFrame:
    """A4: min, max, mean and row count of one column."""
    return nan_to_null(df, [col]).agg(F.min(col).alias("min"), F.max(col).alias("max"),
                  F.avg(col).alias("mean"), F.count(F.lit(1)).alias("n"))


def min_across(frames: Sequence[DataFrame], col: str) -> DataFrame:
    """A5: the smallest value of ``col`` over several tables (one union, one agg)."""
    u = frames[0].select(col)
    for f in frames[1:]:
        u = u.unionByName(f.select(col))
    return nan_to_null(u, [col]).agg(F.min(col).alias("min"))


# ---------------------------------------------------------------------------
# quantiles


def _long_values(df: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Unpivot numeric columns into (by..., variable, value) without nulls and NaNs."""
    cols = list(cols)
    if len(cols) == 1:
        out = df.select(*by, F.lit(cols[0]).alias("variable"),
                        F.col(cols[0]).cast("double").alias("value"))
    else:
        out = df.unpivot(list(by), [F.col(c).cast("double").alias(c) for c in cols],
                         "variable", "value") if by else df.select(
            F.explode(F.array(*[F.struct(F.lit(c).alias("variable"),
                                         F.col(c).cast("double").alias("value")) for c in cols]))
            .alias("_s")).select("_s.*")
    # NaN is missing, as in pandas: every method then sees the same values
    return out.where(F.col("value").isNotNull() & ~F.isnan("value"))


def _pname(p: float) -> str:
    s = f"{p * 100:g}".replace(".", "_")
    return f"q{s}"


def quantiles(df: DataFrame, cols, probs: Sequence[float], by=(), method: str = "auto",
              buckets: int | None = None, accuracy: int = 10000) -> DataFrame:
    """Quantiles with linear interpolation (pandas/NumPy default, DuckDB quantile_cont).

    Returns one row per (by..., variable) with columns ``q25``, ``q50`` … named by
    ``_pname``; ``n`` is the non-null count.  ``method="auto"`` is selection by digits (a few
    aggregation passes for any number of groups, values never shuffled).
    """
    by = _as_list(by)
    cols = _as_list(cols)
    probs = [float(p) for p in probs]
    names = [_pname(p) for p in probs]
    keys = by + ["variable"]
    if method in ("auto", "select"):
        # the columns are read several times: a derived input is materialised once, as it is; columns
        # go by number until the end, since the passes join on the key
        from ..session import materialize_if_derived
        df = materialize_if_derived(df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols if c not in by]))
        names_of = F.array(*[F.lit(c) for c in cols])
        number = F.array_position(names_of, F.col("variable")).cast("int").alias(NUMBER)
        q = select_quantiles(_long_values(df, cols, by).select(*by, number, "value"), by + [NUMBER], probs, names)
        return q.select(*by, F.element_at(names_of, F.col(NUMBER)).alias("variable"), "n", *names)
    long = _long_values(df, cols, by)
    if method == "rank":
        # these read the values several times: a derived input is materialised once
        # (keys and one value column only) instead of being recomputed per pass
        from ..session import materialize_if_derived
        long = materialize_if_derived(long)
    if method in ("percentile", "approx"):
        if method == "percentile":
            q = F.percentile(F.col("value"), F.array(*[F.lit(p) for p in probs]))
        else:
            q = F.percentile_approx(F.col("value"), F.array(*[F.lit(p) for p in probs]), accuracy)
        agg = long.groupBy(*keys).agg(q.alias("_q"), F.count(F.lit(1)).alias("n"))
        return agg.select(*keys, "n", *[F.col("_q")[i].alias(nm) for i, nm in enumerate(names)])
    if method != "rank":
        raise ValueError(method)
    # equal values are counted before anything is ordered, so a value that many rows share is
    # one row here: _r is the first rank it takes, _e the first rank after it
    values = materialize_if_derived(long.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("_v")))
    b, nb = range_buckets(values, keys, ["value"], buckets)
    w = Window.partitionBy(*keys, _B).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = b.withColumn("_rn", F.sum("_v").over(w) - F.col("_v"))
    if nb > 1:
        counts = b.groupBy(*keys, _B).agg(F.sum("_v").alias("_c"))
        ws = Window.partitionBy(*keys).orderBy(_B)
        offsets = counts.select(
            *keys, _B,
            F.coalesce(F.sum("_c").over(ws.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            .alias("_off"),
            F.sum("_c").over(Window.partitionBy(*keys)).alias("n"))
        r = null_safe_join(ranked, offsets, keys + [_B], "inner").withColumn("_r", F.col("_off") + F.col("_rn"))
    else:
        r = ranked.withColumns({"_r": F.col("_rn"),
                                "n": F.sum("_v").over(Window.partitionBy(*keys, _B))})
    r = r.withColumn("_e", F.col("_r") + F.col("_v"))
    nm1 = F.col("n") - 1
    holds = lambda rank: (F.col("_r") <= rank) & (rank < F.col("_e"))
    wanted = None
    for p in probs:
        h = nm1 * F.lit(p)
        cond = holds(F.floor(h)) | holds(F.ceil(h))
        wanted = cond if wanted is None else (wanted | cond)
    picked = r.where(wanted).select(*keys, "n", "_r", "_e", "value")
    aggs = []
    for p, nm in zip(probs, names):
        h = nm1 * F.lit(p)
        lo = F.max(F.when(holds(F.floor(h)), F.col("value")))
        hi = F.max(F.when(holds(F.ceil(h)), F.col("value")))
        frac = F.max(h - F.floor(h))
        aggs.append(between(lo, hi, frac).alias(nm))
    return picked.groupBy(*keys, "n").agg(*aggs).select(*keys, "n", *names)


def describe(df: DataFrame, cols, method: str = "auto", by=()) -> DataFrame:
    """Pandas ``describe()`` as a long table.

    One row per (by..., variable): count, mean, std (ddof 1), min, q25, q50, q75, max.
    """
    by = _as_list(by)
    cols = _as_list(cols)
    long = _long_values(df, cols, by)
    keys = by + ["variable"]
    moments = long.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"))
    q = quantiles(df, cols, [0.25, 0.5, 0.75], by=by, method=method).drop("n")
    return (null_safe_join(moments, q, keys)
            .select(*keys, "count", "mean", "std", "min", "q25", "q50", "q75", "max"))


def iqr_bounds(df: DataFrame, col: str, k: float = 1.5, method: str = "auto") -> DataFrame:
    """Q1, Q3, IQR, fences and the number / share of rows outside them.

    The two quartiles (two numbers) come back to the driver and enter the counting
    pass as literals.
    """
    from ..session import materialize_if_derived
    df = materialize_if_derived(df.select(col))   # read by the quartile and counting passes
    q = quantiles(df, [col], [0.25, 0.75], method=method).first()
    spark = df.sparkSession
    if q is None:
        return spark.createDataFrame(
            [], "q1 double, q3 double, iqr double, lower double, upper double, "
                "n_outliers long, n long, outlier_pct double")
    q1, q3 = float(q["q25"]), float(q["q75"])
    iqr = q3 - q1
    lower, upper = q1 - k * iqr, q3 + k * iqr
    x = F.col(col).cast("double")
    return nan_to_null(df, [col]).agg(F.count_if((x < lower) | (x > upper)).alias("n_outliers"),
                  F.count(F.lit(1)).alias("n")).select(
        F.lit(q1).alias("q1"), F.lit(q3).alias("q3"), F.lit(iqr).alias("iqr"),
        F.lit(lower).alias("lower"), F.lit(upper).alias("upper"), "n_outliers", "n",
        (F.col("n_outliers") / F.col("n") * 100.0).alias("outlier_pct"))


def clip(df: DataFrame, col: str, lower: float, upper: float) -> DataFrame:
    """Clip into [lower, upper]; null stays null and NaN NaN."""
    return df.withColumn(col, clip_col(col, lower, upper))


# ---------------------------------------------------------------------------
# correlation and fits


def _pair_sums(x: str, y: str) -> list[Column]:
    return [F.regr_sxx(F.col(y), F.col(x)), F.regr_syy(F.col(y), F.col(x)),
            F.regr_sxy(F.col(y), F.col(x))]


def safe_corr_value(sxx: Column, syy: Column, sxy: Column) -> Column:
    """Pearson r from centred sums; zero variance gives null instead of an error, and so do infinite values."""
    return F.nanvl(F.try_divide(sxy, F.sqrt(sxx * syy)), F.lit(None).cast("double"))


def corr_long(df: DataFrame, cols, by=(), name: str = "pearson_r") -> DataFrame:
    """A10: pairwise-complete Pearson matrix as a long table (var_x, var_y, r).

    One aggregation computes the centred sums of every pair (``regr_sxx`` etc. skip a
    row when either value is null, which is pandas' pairwise-complete rule); the
    single result row is exploded into p² rows.  Constant columns give null.  From ``wide.WIDE`` columns on,
    without groups, the sums come from matrix products instead.
    """
    cols = _as_list(cols)
    by = _as_list(by)
    if len(cols) >= wide.WIDE and not by:
        return wide.corr_pairs(df, cols, name)
    aggs = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if j < i:
                continue
            aggs.append(safe_corr_value(*_pair_sums(a, b)).alias(f"_c_{i}_{j}"))
    row = nan_to_null(df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols]), cols).groupBy(*by).agg(*aggs)
    cells = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            src = f"_c_{min(i, j)}_{max(i, j)}"
            cells.append(F.struct(F.lit(a).alias("var_x"), F.lit(b).alias("var_y"),
                                  F.col(src).alias(name)))
    return row.select(*by, F.inline(F.array(*cells)))


def linregress(df: DataFrame, x: str, y: str, by=()) -> DataFrame:
    """Scipy ``linregress`` on pairwise-complete rows, optionally per group.

    slope, intercept, r, p (two-sided t test of slope = 0, n - 2 dof), stderr of
    the slope and of the intercept.  One aggregation; p comes from the t tail
    computed in-column (``tidemark.functions.dist``).
    """
    from ..functions.dist import t_sf_of

    by = _as_list(by)
    X, Y = F.col(x), F.col(y)
    agg = nan_to_null(df, [x, y]).groupBy(*by).agg(
        F.regr_count(Y, X).alias("n"), F.regr_sxx(Y, X).alias("sxx"),
        F.regr_syy(Y, X).alias("syy"), F.regr_sxy(Y, X).alias("sxy"),
        F.regr_avgx(Y, X).alias("mx"), F.regr_avgy(Y, X).alias("my"),
        F.sum(F.when(X.isNotNull() & Y.isNotNull(), X * X)).alias("sx2"))
    slope = F.try_divide(F.col("sxy"), F.col("sxx"))
    r = safe_corr_value(F.col("sxx"), F.col("syy"), F.col("sxy"))
    # rounding may carry a perfect fit past 1
    r = F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))
    dof = F.col("n") - 2
    stderr = F.sqrt(F.try_divide((1 - r * r) * F.col("syy"), F.col("sxx") * dof))
    tstat = F.try_divide(r * F.sqrt(dof.cast("double")), F.sqrt(1 - r * r))
    out = agg.select(
        *by, "n", slope.alias("slope"),
        (F.col("my") - slope * F.col("mx")).alias("intercept"),
        r.alias("rvalue"), stderr.alias("stderr"),
        (stderr * F.sqrt(F.try_divide(F.col("sx2"), F.col("n").cast("double")))).alias(
            "intercept_stderr"),
        F.abs(tstat).alias("_t"), dof.alias("_dof"))
    perfect = (F.abs("rvalue") == 1.0) & (F.col("_dof") > 0)
    return out.withColumn("pvalue", F.when(perfect, F.lit(0.0)).otherwise(
        F.lit(2.0) * t_sf_of("_t", "_dof"))) \
        .select(*by, "n", "slope", "intercept", "rvalue", "pvalue", "stderr", "intercept_stderr")


def polyfit_per_feature(df: DataFrame, xs, y: str) -> DataFrame:
    """Degree-1 least squares of ``y`` on each feature separately.

    Rows are unpivoted to (feature, x, y) and fitted in one grouped aggregation.
    """
    xs = _as_list(xs)
    long = nan_to_null(df.unpivot([y], [F.col(c).cast("double").alias(c) for c in xs], "feature", "x"), ["x", y])
    return (long.groupBy("feature").agg(
        F.regr_slope(F.col(y), F.col("x")).alias("slope"),
        F.regr_intercept(F.col(y), F.col("x")).alias("intercept"),
        F.regr_count(F.col(y), F.col("x")).alias("n")))


def distinct_first_seen(df: DataFrame, col: str, order) -> DataFrame:
    """Distinct values with their first position (ascending ``order``)."""
    okey = F.struct(*[F.col(o) for o in _as_list(order)])
    return (df.where(F.col(col).isNotNull()).groupBy(col)
            .agg(F.min(okey).alias("_first"))
            .select(col, "_first"))


#: Groups (a row of a few numbers each) whose table may be broadcast to the rows; more groups are joined by a shuffle.
_FEW_GROUPS = 1 << 16


def _at_hand(groups: DataFrame) -> DataFrame:
    """Marked for broadcast where a count shows that the groups are few."""
    return F.broadcast(groups) if groups.count() <= _FEW_GROUPS else groups


def _present(df: DataFrame, col: str, by=()) -> DataFrame:
    """(by..., _x): a column's values that aren't missing, as doubles."""
    x = df.select(*by, F.col(col).cast("double").alias("_x"))
    return nan_to_null(x, ["_x"]).where(F.col("_x").isNotNull())


def box_stats(df: DataFrame, col: str, by=(), whis: float = 1.5, method: str = "auto") -> DataFrame:
    """Box-plot numbers per group: quartiles, whisker ends, outlier count.

    Whiskers follow matplotlib: the most extreme data points inside the fences.
    Grouped: the per-group quartile table (one row per group) is equi-joined back.
    """
    from ..session import materialize_if_derived
    by = _as_list(by)
    # read by the quartile passes and the whisker pass: a derived input is materialised once
    df = materialize_if_derived(df.select(*by, col))
    q = quantiles(df, [col], [0.25, 0.5, 0.75], by=by, method=method).select(
        *by, "n", F.col("q25").alias("q1"), F.col("q50").alias("median"), F.col("q75").alias("q3"))
    x = _present(df, col, by)
    if by:
        j = null_safe_join(x, _at_hand(q), by, "inner")
    else:
        r = q.first()
        if r is None:
            return q.select("n", "q1", "median", "q3", F.lit(None).cast("double").alias("whisker_lo"),
                            F.lit(None).cast("double").alias("whisker_hi"),
                            F.lit(0).cast("long").alias("n_outliers"))
        j = x.select("_x", *[F.lit(r[c]).alias(c) for c in ("n", "q1", "median", "q3")])
    iqr = F.col("q3") - F.col("q1")
    lo_f = F.col("q1") - whis * iqr
    hi_f = F.col("q3") + whis * iqr
    inside = (F.col("_x") >= lo_f) & (F.col("_x") <= hi_f)
    return j.groupBy(*by, "n", "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("_x"))).alias("whisker_lo"),
        F.max(F.when(inside, F.col("_x"))).alias("whisker_hi"),
        F.count_if(~inside).alias("n_outliers"))


def box_outliers(df: DataFrame, col: str, by=(), whis: float = 1.5) -> DataFrame:
    """The rows that a box plot draws as points: those outside their group's fences, columns as they are."""
    from ..session import materialize_if_derived
    by = _as_list(by)
    df = materialize_if_derived(df)   # read by the quartile passes and the filter
    q = quantiles(df, [col], [0.25, 0.75], by=by).select(*by, F.col("q25").alias("_q1"), F.col("q75").alias("_q3"))
    if by:
        j = null_safe_join(df, _at_hand(q), by, "inner")
    else:
        r = q.first()
        j = df.withColumns({c: F.lit(r[c] if r else None).cast("double") for c in ("_q1", "_q3")})
    reach = whis * (F.col("_q3") - F.col("_q1"))
    x = F.col(col).cast("double")
    return j.where(~F.isnan(x) & ((x < F.col("_q1") - reach) | (x > F.col("_q3") + reach))).select(*df.columns)


# ---------------------------------------------------------------------------
# histogram and density


def auto_bins(n: int, lo: float, hi: float, q1: float, q3: float) -> int:
    """NumPy's ``bins='auto'``: the narrower of the Sturges and Freedman–Diaconis widths."""
    if n == 0 or hi is None or lo is None or math.isinf(hi) or math.isinf(lo):
        return 1
    rng = hi - lo
    if rng <= 0:
        return 1
    sturges = rng / (math.log2(n) + 1.0)
    iqr = (q3 - q1) if (q1 is not None and q3 is not None) else 0.0
    fd = 2.0 * iqr * n ** (-1.0 / 3.0)
    width = min(fd, sturges) if fd > 0 else sturges
    return max(1, int(math.ceil(rng / width)))


def histogram(df: DataFrame, col: str, bins: int | None = None, method: str = "auto") -> DataFrame:
    """Equal-width histogram counts (bin, n_bins, lo, hi, count); bins without values
    are left out (a long tail can make millions of them), ``n_bins`` counts them all.

    The bin count comes from one moments+quartiles pass (NumPy 'auto' rule unless
    given).  Each row's bin is a column expression; the last bin is closed on the
    right, as in NumPy.
    """
    from ..session import materialize_if_derived
    x = materialize_if_derived(_present(df, col))   # read by the quantile passes and the counting pass
    if bins is None:
        # one quantile call gives the count, the extremes (q0, q100) and the quartiles
        qr = quantiles(x, ["_x"], [0.0, 0.25, 0.75, 1.0], method=method).first()
        n = qr["n"] if qr else 0
        lo, hi = (qr["q0"], qr["q100"]) if qr else (None, None)
        bins = auto_bins(n, lo, hi, qr["q25"] if qr else None, qr["q75"] if qr else None)
    else:
        st = x.agg(F.count(F.lit(1)).alias("n"), F.min("_x").alias("lo"), F.max("_x").alias("hi")).first()
        n, lo, hi = st["n"], st["lo"], st["hi"]
    spark = df.sparkSession
    if n == 0:
        return spark.createDataFrame([], "bin long, n_bins long, lo double, hi double, count long")
    lo_v, hi_v = float(lo), float(hi)
    if math.isinf(lo_v) or math.isinf(hi_v):
        raise ValueError("infinite values have no bins")
    if hi_v == lo_v:
        lo_v, hi_v = lo_v - 0.5, hi_v + 0.5
    idx = F.least(F.lit(bins - 1).cast("long"), F.floor((F.col("_x") - F.lit(lo_v)) * F.lit(bins)
                                                          / F.lit(hi_v - lo_v)))
    counts = x.groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    width = (hi_v - lo_v) / bins
    return counts.select("bin", F.lit(bins).cast("long").alias("n_bins"),
                         (F.lit(lo_v) + F.col("bin") * F.lit(width)).alias("lo"),
                         (F.lit(lo_v) + (F.col("bin") + 1) * F.lit(width)).alias("hi"), "count")


#: Moments of a box, and how many bandwidths away its values are still added.
_KDE_TERMS, _KDE_REACH = 14, 9.0


def kde_grid(df: DataFrame, col: str, grid_size: int = 200, cut: float = 0.0,
             bw: float | None = None) -> DataFrame:
    """Gaussian kernel density on an even grid (Scott's bandwidth by default).

    bandwidth = std(ddof 1) · n^(-1/5) (SciPy's 'scott' factor).  A fast Gauss transform: values
    are cut into boxes half a bandwidth wide, one aggregation keeps each box's first ``_KDE_TERMS`` moments
    about its centre, and a box adds a Hermite series to the grid points within ``_KDE_REACH`` bandwidths.
    A value's kernel is then off by less than 1e-13 of its height (0.25ⁿ/√n! summed from the first term left out)
    and by less than 3e-18 where it isn't added, whatever the number of rows.
    """
    from ..session import materialize_if_derived
    x = materialize_if_derived(_present(df, col))
    st = x.agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("_x").alias("sd"),
               F.min("_x").alias("lo"), F.max("_x").alias("hi")).first()
    n = st["n"]
    spark = df.sparkSession
    if not n or st["sd"] is None or st["sd"] == 0:
        return spark.createDataFrame([], "i int, x double, density double")
    if math.isinf(st["lo"]) or math.isinf(st["hi"]):
        raise ValueError("infinite values have no density")
    h = float(bw) if bw else float(st["sd"]) * n ** (-1.0 / 5.0)
    lo, hi = float(st["lo"]) - cut * h, float(st["hi"]) + cut * h
    step = (hi - lo) / (grid_size - 1) if grid_size > 1 else 0.0
    unit, width, base = math.sqrt(2.0) * h, h / 2.0, float(st["lo"])
    centre = F.lit(base) + (F.col("_box") + 0.5) * F.lit(width)
    v = x.withColumn("_box", F.floor((F.col("_x") - F.lit(base)) / F.lit(width))) \
        .select("_box", ((F.col("_x") - centre) / F.lit(unit)).alias("_v"))
    power, moments = F.lit(1.0), []
    for k in range(_KDE_TERMS):
        moments.append(F.sum(power) / float(math.factorial(k)))
        power = power * F.col("_v")
    boxes = v.groupBy("_box").agg(F.array(*moments).alias("_m")).withColumn("_c", centre)
    if step > 0:
        reach = F.lit(_KDE_REACH * h)
        first = F.greatest(F.lit(0), F.ceil((F.col("_c") - reach - F.lit(lo)) / F.lit(step)).cast("int"))
        last = F.least(F.lit(grid_size - 1), F.floor((F.col("_c") + reach - F.lit(lo)) / F.lit(step)).cast("int"))
    else:
        first = last = F.lit(0)
    near = boxes.withColumns({"_a": first, "_b": last}).where("_a <= _b") \
        .select("_m", "_c", F.explode(F.sequence("_a", "_b")).alias("i"))
    near = near.withColumn("_u", (F.lit(lo) + F.col("i") * F.lit(step) - F.col("_c")) / F.lit(unit))
    # Hermite functions by their recurrence: h₀ = exp(-u²), hₙ₊₁ = 2u hₙ - 2n hₙ₋₁
    series = F.aggregate(
        "_m", F.struct(F.lit(0.0).alias("before"), F.exp(-F.col("_u") * F.col("_u")).alias("now"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("k")),
        lambda t, m: F.struct(t["now"].alias("before"), (2.0 * F.col("_u") * t["now"] - 2.0 * t["k"] * t["before"]).alias("now"),
                              (t["sum"] + m * t["now"]).alias("sum"), (t["k"] + 1.0).alias("k")),
        lambda t: t["sum"])
    sums = near.groupBy("i").agg(F.sum(series).alias("s"))
    norm = 1.0 / (n * h * math.sqrt(2 * math.pi))
    grid = spark.range(grid_size).select(F.col("id").cast("int").alias("i"))
    return grid.join(sums, "i", "left").select(
        "i", (F.lit(lo) + F.col("i") * F.lit(step)).alias("x"), (F.coalesce("s", F.lit(0.0)) * F.lit(norm)).alias("density"))


# ---------------------------------------------------------------------------
# sorts and picks


def top_abs_corr(corr: DataFrame, target: str, k: int = 2, name: str = "pearson_r") -> DataFrame:
    """The k features most correlated (in absolute value) with ``target``."""
    return (corr.where((F.col("var_x") == target) & (F.col("var_y") != target))
            .orderBy(F.desc(F.abs(F.col(name))), F.col("var_y")).limit(k))


def best_by(df: DataFrame, score: str, tie: str) -> DataFrame:
    """The row with the highest ``score``; first by ``tie`` wins on equal scores."""
    return df.orderBy(F.desc(score), F.asc(tie)).limit(1)
