"""End-to-end studies and their sectioned report (K4).

A study = panel → transform (min-max scaling or percentage change) → describe,
correlation → 80/20 split → OLS on the train rows → test scores → VIF → inference
summary → verdict.  The report is one long DataFrame ``(section, row_name,
col_name, value, text)`` assembled from the operators' outputs; every number in it
came from a Spark aggregation over the panel (the driver only holds p×p results).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import models as M
from ..operators import stats as ST
from ..session import cut_lineage
from . import sqlkit as Q

X3 = Q.RATE_NAMES
COLS4 = Q.PANEL_COLS
_SCHEMA = "section string, row_name string, col_name string, value double, text string"


def _long(df: DataFrame, section: str, row_col: str, value_cols) -> DataFrame:
    return df.unpivot([row_col], [F.col(c).cast("double").alias(c) for c in value_cols],
                      "col_name", "value").select(
        F.lit(section).alias("section"), F.col(row_col).cast("string").alias("row_name"),
        "col_name", "value", F.lit(None).cast("string").alias("text"))


def regression_sections(spark: SparkSession, data: DataFrame) -> tuple[list[DataFrame], float]:
    """(coefficients, test scores, VIF, OLS summary and coefficient table; the test rows' R²) of a panel
    (Date, price, three rates)."""
    split = M.train_test_split(data, ["Date"], 0.2, 42)  # a column predicate over ``data``
    train = split.where(~F.col("is_test"))
    fit = M.ols(train, X3, "price")
    sc = M.scores(split, [fit], "price", where=F.col("is_test"))
    sm = M.ols_summary(train, X3, "price", order="Date", fit=fit, buckets=1)
    return [
        _long(fit.coef_df(spark), "coefficients", "feature", ["coef"]),
        _long(sc, "test_scores", "model", ["mse", "r2"]),
        _long(M.vif_df(spark, M.vif(data, X3, constant=True)), "vif", "feature", ["vif"]),
        _long(sm.stats_df(spark), "ols_summary", "stat", ["value"]),
        _long(sm.coef_table_df(spark), "ols_coefficients", "term", ["coef", "std_err", "t", "p_value", "ci_low", "ci_high"]),
    ], float(sc.first()["r2"])


def study_report(spark: SparkSession, data: DataFrame, title: str) -> DataFrame:
    """K4 for a prepared panel ``data`` (Date, price, three rates)."""
    data = cut_lineage(data)
    parts = [spark.createDataFrame([("title", "", "", float(data.count()), title)], _SCHEMA)]
    desc = ST.describe(data, COLS4, method="percentile")
    parts.append(_long(desc, "describe", "variable", ["count", "mean", "std", "min", "q25", "q50",
                                                       "q75", "max"]))
    corr = ST.corr_long(data, COLS4)
    parts.append(corr.select(F.lit("correlation").alias("section"), F.col("var_x").alias("row_name"),
                             F.col("var_y").alias("col_name"), F.col("pearson_r").alias("value"),
                             F.lit(None).cast("string").alias("text")))
    sections, r2 = regression_sections(spark, data)
    parts += sections
    verdict = spark.createDataFrame([(r2,)], "r2 double").select(
        F.lit("remarks").alias("section"), F.lit("r2").alias("row_name"), F.lit("verdict").alias("col_name"),
        F.col("r2").alias("value"), M.verdict("r2").alias("text"))
    parts.append(verdict)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
