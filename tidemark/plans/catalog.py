"""Registered queries: one per operator of SURVEY §2, each with its DuckDB oracle.

Every query reads the driver tables (or what Spark derives from them) in full.
Floating results are rounded identically on both sides (money-like values to 2
decimals, ratios and coefficients to 6–9), because sums in two engines differ in
their last bits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sqlkit as Q
from . import tables as TB

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def rnd(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), d) for c, d in digits.items()})


def sql_round(cols: dict[str, int]) -> str:
    return ", ".join(f"round({c}, {d}) AS {c}" for c, d in cols.items())


# ---------------------------------------------------------------------------
# the daily panel (entry 2 of the reference: daily price ⟗ rates → fill → nearest)


def panel(spark: SparkSession, sf_dir: str, materialize: bool = True) -> DataFrame:
    """The daily study panel (Date, price, CNY_JPY, PHP_JPY, VND_JPY).

    One row per calendar day, whatever the size of the facts behind it.  Studies run
    many aggregations over it, so it is checkpointed once into the shared checkpoint
    folder (lineage cut; a lost executor re-reads it instead of recomputing).
    """
    from ..operators.align import asof_nearest, fill_both
    from ..session import cut_lineage
    keep = cut_lineage if materialize else (lambda d: d)
    # the fact tables are scanned once each, down to one row per day.  The rates are
    # read twice by the nearest join (calendar keys and payload), so they are
    # materialised; the daily prices stream through the join once.
    daily = TB.daily_price(spark, sf_dir)
    # one row per calendar day: a single bucket by construction
    rates = fill_both(keep(TB.rates_wide_one_scan(spark, sf_dir)), "Date", buckets=1)
    return keep(asof_nearest(daily, rates, on="Date"))


_PANEL_SQL = Q.cte(**Q.panel_ctes())


@query("flagship_panel_corr",
       _PANEL_SQL + Q.corr_long("panel", Q.PANEL_COLS))
def flagship_panel_corr(spark, sf_dir):
    from ..operators.stats import corr_long
    return rnd(corr_long(panel(spark, sf_dir), Q.PANEL_COLS), {"pearson_r": 9})


@query("a1_daily_mean_price", Q.DAILY)
def a1_daily_mean_price(spark, sf_dir):
    return TB.daily_price(spark, sf_dir)


@query("j1_full_outer_rates", Q.RATES)
def j1_full_outer_rates(spark, sf_dir):
    return TB.rates_wide(spark, sf_dir)


@query("j1_full_outer_one_scan", Q.RATES)
def j1_full_outer_one_scan(spark, sf_dir):
    return TB.rates_wide_one_scan(spark, sf_dir)


@query("w1_fill_forward_rates",
       Q.cte(rates=Q.RATES) + "SELECT Date, "
       + ", ".join(f"{Q.ffill(c)} AS {c}" for c in Q.RATE_NAMES) + " FROM rates")
def w1_fill_forward_rates(spark, sf_dir):
    from ..operators.align import fill_forward
    return fill_forward(TB.rates_wide_one_scan(spark, sf_dir), "Date")


@query("w2_fill_backward_rates",
       Q.cte(rates=Q.RATES) + "SELECT Date, "
       + ", ".join(f"{Q.bfill(c)} AS {c}" for c in Q.RATE_NAMES) + " FROM rates")
def w2_fill_backward_rates(spark, sf_dir):
    from ..operators.align import fill_backward
    return fill_backward(TB.rates_wide_one_scan(spark, sf_dir), "Date")


@query("w1w2_fill_both_rates",
       Q.cte(rates=Q.RATES, filled=Q.filled())
       + "SELECT * FROM filled")
def w1w2_fill_both_rates(spark, sf_dir):
    from ..operators.align import fill_both
    return fill_both(TB.rates_wide_one_scan(spark, sf_dir), "Date")


@query("j2_nearest_panel", _PANEL_SQL + "SELECT * FROM panel")
def j2_nearest_panel(spark, sf_dir):
    return panel(spark, sf_dir)


from . import q_study  # noqa: E402,F401  (registers its queries)
from . import q_facts  # noqa: E402,F401
from . import q_sources  # noqa: E402,F401
from . import q_groups  # noqa: E402,F401
from . import q_more  # noqa: E402,F401
from . import q_values  # noqa: E402,F401
from . import q_items  # noqa: E402,F401


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v[0] for k, v in REGISTRY.items()}


def all_sql() -> dict[str, str]:
    return {k: v[1] for k, v in REGISTRY.items() if v[1] is not None}
