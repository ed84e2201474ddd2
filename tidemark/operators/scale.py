"""Column scalers fitted with one aggregation.

Each ``fit_*`` returns a small ``Scaling`` (one centre and one scale per column, the
only thing that reaches the driver); ``Scaling.apply`` is pure column arithmetic with
literal parameters, so it stays inside whole-stage codegen.  The reference's
conventions are kept where Spark ML differs: population std, constant columns
mapped to 0, exact quartiles.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clean import nan_to_null
from .align import _as_list
from .stats import quantiles


@dataclass(frozen=True)
class Scaling:
    kind: str
    center: dict
    scale: dict

    def apply(self, df: DataFrame, suffix: str | None = None) -> DataFrame:
        cols = {}
        for c in self.center:
            v = (F.col(c) - F.lit(self.center[c])) / F.lit(self.scale[c])
            cols[(c + suffix) if suffix else c] = v
        return df.withColumns(cols)

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [(c, float(self.center[c]), float(self.scale[c])) for c in self.center]
        return spark.createDataFrame(rows, "variable string, center double, scale double")


def fit_standard(df: DataFrame, cols) -> Scaling:
    """M1: (x - mean) / std_pop; a zero std divides by 1."""
    cols = _as_list(cols)
    r = nan_to_null(df, cols).agg(*[F.avg(c).alias(f"m_{i}") for i, c in enumerate(cols)],
               *[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(cols)]).first()
    # an all-null column has no mean: centre 0, scale 1 (it stays null)
    center = {c: float(r[f"m_{i}"]) if r[f"m_{i}"] is not None else 0.0 for i, c in enumerate(cols)}
    scale = {c: (float(r[f"s_{i}"]) if r[f"s_{i}"] else 1.0) for i, c in enumerate(cols)}
    return Scaling("standard", center, scale)


def fit_minmax(df: DataFrame, cols) -> Scaling:
    """M2: (x - min) / (max - min); a zero range divides by 1 (so constants map to 0)."""
    cols = _as_list(cols)
    r = nan_to_null(df, cols).agg(*[F.min(c).alias(f"lo_{i}") for i, c in enumerate(cols)],
               *[F.max(c).alias(f"hi_{i}") for i, c in enumerate(cols)]).first()
    center, scale = {}, {}
    for i, c in enumerate(cols):
        if r[f"lo_{i}"] is None:          # all null: the column stays null
            center[c], scale[c] = 0.0, 1.0
            continue
        lo, hi = float(r[f"lo_{i}"]), float(r[f"hi_{i}"])
        center[c] = lo
        scale[c] = (hi - lo) if hi != lo else 1.0
    return Scaling("minmax", center, scale)


def fit_robust(df: DataFrame, cols, method: str = "auto", quartiles: dict | None = None) -> Scaling:
    """M3: (x - median) / (Q3 - Q1) with exact quartiles; a zero IQR divides by 1.

    ``quartiles`` (variable → row with q25, q50, q75) lets a caller reuse quartiles it
    already computed in a shared pass.
    """
    cols = _as_list(cols)
    q = quartiles or {r["variable"]: r for r in
                      quantiles(df, cols, [0.25, 0.5, 0.75], method=method).collect()}  # p rows
    center, scale = {}, {}
    for c in cols:
        r = q.get(c)
        if r is None:                     # all null: the column stays null
            center[c], scale[c] = 0.0, 1.0
            continue
        center[c] = float(r["q50"])
        iqr = float(r["q75"]) - float(r["q25"])
        scale[c] = iqr if iqr != 0 else 1.0
    return Scaling("robust", center, scale)


def scale_columns(df: DataFrame, cols, kind: str, suffix: str | None = None,
                  method: str = "auto") -> DataFrame:
    fit = {"standard": fit_standard, "minmax": fit_minmax}.get(kind)
    s = fit(df, cols) if fit else fit_robust(df, cols, method)
    return s.apply(df, suffix)
