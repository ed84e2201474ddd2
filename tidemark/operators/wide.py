"""Cross products of many columns in one pass.

With p columns the pairwise forms need an aggregate per pair.  Here each task adds up XᵀX, Xᵀ M and MᵀM of its
rows (M: 1 where a value is present, 0 where it is missing; missing values count 0 in X) by matrix products of
Arrow batches, and hands on one row per pair; a grouped sum by pair, with as many groups as pairs, adds the tasks.
Every part's sums are about its own means, and parts are put together by the distances of these, so the sums keep
their digits and the rows are read once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, ship_package

#: Columns from which the matrix form is used; it is about where the pairwise plan's code stops compiling.
WIDE = 24
_SUMS = ("n", "x", "y", "xx", "yy", "xy")
_SCHEMA = pa.schema([("i", pa.int32()), ("j", pa.int32()), *[(c, pa.float64()) for c in _SUMS]])


def cross_products(df: DataFrame, cols: list, complete: bool = False) -> tuple[DataFrame, np.ndarray]:
    """((i, j, n, x, y, xx, yy, xy) for every pair i <= j, column means).

    The sums run over the rows where both columns are present (all of them, if ``complete``), and are of the
    columns less their means.
    """
    ship_package(df.sparkSession)
    p = len(cols)
    missing = F.lit(float("nan"))
    # the second column has a lambda function, and Spark leaves a projection with one out of whole-stage code.  There the values of
    # many columns are one method, which the JVM interprets once it is long; outside they are many short ones, which it compiles
    x = df.select(F.array(*[F.coalesce(F.col(c).cast("double"), missing) for c in cols]).alias("v"),
                  F.transform(F.array(F.lit(0)), lambda v: v).alias("_apart"))
    i, j = np.triu_indices(p)

    def add_up(batches):
        total = None
        np.seterr(invalid="ignore", divide="ignore", over="ignore")
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                raw = b.column(0).slice(at, 4096).flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
                if complete:
                    raw = raw[~np.isnan(raw).any(axis=1)]
                part = _sums(raw)
                total = part if total is None else _merged(total, part)
        if total is not None:
            n, mean, own, both = total
            some = n[i, j] > 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)),
                 *[pa.array(v, mask=~some) for v in (n[i, j], mean[i, j], mean[j, i], own[i, j], own[j, i], both[i, j])]], schema=_SCHEMA)

    parts = x.mapInArrow(add_up, "i int, j int, " + ", ".join(f"{c} double" for c in _SUMS))
    # the tasks' means go into one by their distances from the least of them, so a constant column's stays what it is
    w = Window.partitionBy("i", "j")
    mean = {c: F.min(c).over(w) + F.sum(F.col("n") * (F.col(c) - F.min(c).over(w))).over(w) / F.sum("n").over(w) for c in "xy"}
    far = parts.withColumns({f"m{c}": m for c, m in mean.items()})
    dx, dy = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    total = cut_lineage(far.groupBy("i", "j").agg(
        F.coalesce(F.sum("n"), F.lit(0.0)).alias("n"), F.first("mx", ignorenulls=True).alias("mx"), F.first("my", ignorenulls=True).alias("my"),
        F.sum(F.col("xx") + F.col("n") * dx * dx).alias("xx"), F.sum(F.col("yy") + F.col("n") * dy * dy).alias("yy"),
        F.sum(F.col("xy") + F.col("n") * dx * dy).alias("xy")))
    shift = np.zeros(p)
    for r in total.where("i = j").select("i", "mx").collect():
        # a column of infinite values is not centred, and only its own sums are lost
        shift[r.i] = r.mx if r.mx is not None and np.isfinite(r.mx) else 0.0
    shifts = F.array(*[F.lit(float(s)) for s in shift])
    ax, ay = F.col("mx") - F.get(shifts, F.col("i")), F.col("my") - F.get(shifts, F.col("j"))
    sums = {"x": F.col("n") * ax, "y": F.col("n") * ay, "xx": F.col("xx") + F.col("n") * ax * ax,
            "yy": F.col("yy") + F.col("n") * ay * ay, "xy": F.col("xy") + F.col("n") * ax * ay}
    return total.select("i", "j", "n", *[F.coalesce(v, F.lit(0.0)).alias(c) for c, v in sums.items()]), shift


def _sums(raw: np.ndarray) -> tuple[np.ndarray, ...]:
    """(n, mean of i, squares of i, products) over the rows where columns i and j are present, about these means."""
    here = ~np.isnan(raw)
    m = here.astype(np.float64)
    kept = np.where(here, raw, 0.0)
    shift = kept.sum(axis=0) / m.sum(axis=0)
    # one value throughout is its own mean, without rounding
    first = raw[here.argmax(axis=0), np.arange(raw.shape[1])] if len(raw) else shift
    shift = np.where(((kept == first) | ~here).all(axis=0), first, shift)
    shift[~np.isfinite(shift)] = 0.0
    v = np.where(here, raw - shift, 0.0)
    n, x = m.T @ m, v.T @ m
    off = np.where(n > 0, x / n, 0.0)
    return n, np.where(n > 0, shift[:, None] + off, 0.0), (v * v).T @ m - x * off, v.T @ v - x * off.T


def _merged(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """The same of both parts' rows."""
    (na, ma, sa, pa_), (nb, mb, sb, pb) = a, b
    n = na + nb
    # nothing is as far away as what it meets
    d = np.where((na > 0) & (nb > 0), mb - ma, 0.0)
    share = np.where(n > 0, na * nb / n, 0.0)
    mean = np.where(na > 0, ma + d * np.where(n > 0, nb / n, 0.0), mb)
    return n, mean, sa + sb + share * d * d, pa_ + pb + share * d * d.T


def corr_pairs(df: DataFrame, cols: list, name: str) -> DataFrame:
    """(var_x, var_y, r) of all ordered pairs over pairwise complete rows; null without variance or with infinite values."""
    sums, _ = cross_products(df, cols)
    n = F.nullif(F.col("n"), F.lit(0.0))
    sxx, syy, sxy = (F.col("xx") - F.col("x") * F.col("x") / n, F.col("yy") - F.col("y") * F.col("y") / n, F.col("xy") - F.col("x") * F.col("y") / n)
    # what rounding leaves of a constant column's variance is none
    flat = (sxx <= 1e-14 * F.col("xx")) | (syy <= 1e-14 * F.col("yy"))
    r = F.when(~flat, F.nanvl(F.try_divide(sxy, F.sqrt(sxx * syy)), F.lit(None).cast("double")))
    labels = F.array(*[F.lit(c) for c in cols])
    at = lambda k: F.get(labels, F.col(k))
    cells = F.when(F.col("i") == F.col("j"), F.array(F.struct(at("i").alias("var_x"), at("j").alias("var_y")))).otherwise(
        F.array(F.struct(at("i").alias("var_x"), at("j").alias("var_y")), F.struct(at("j").alias("var_x"), at("i").alias("var_y"))))
    return sums.select(F.explode(cells).alias("_p"), r.alias(name)).select("_p.*", name)


def moments(df: DataFrame, cols: list) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, means, centred cross products) of the complete rows: p × p numbers reach the driver."""
    sums, shift = cross_products(df, cols, complete=True)
    p = len(cols)
    s, rest, n = np.zeros((p, p)), np.zeros(p), 0
    rows = sums.collect()
    for r in rows:
        n = int(r.n)
        if not np.isfinite([r.x, r.xy]).all():
            raise ValueError("infinite values can't be fitted")
        if r.i == r.j:
            rest[r.i] = r.x / r.n if r.n else 0.0
        s[r.i, r.j] = s[r.j, r.i] = r.xy
    return n, shift + rest, s - n * np.outer(rest, rest)
