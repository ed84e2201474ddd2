"""Driver tables re-read as the reference's inputs.

* item facts (Date, name, price, category)  ← lineitem ⋈ part
* three daily rate series with natural gaps ← orders, avg o_totalprice per day for the
  priorities '1-URGENT', '2-HIGH', '3-MEDIUM' (named CNY_JPY, PHP_JPY, VND_JPY)
* monthly side series ("gasoline")          ← orders '5-LOW', avg by (year, month)
* weekly item keys (2-digit year, month, week) ← o_orderdate of the item's order
* ticks                                     ← events (ts, event_type, value)

Every function reads only the columns it needs, so the Parquet scans are pruned and
the priority filters are pushed into the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.align import full_outer_on

# Fixed mapping of order priorities to the three rate series and the side series.
RATE_SERIES = {"CNY_JPY": "1-URGENT", "PHP_JPY": "2-HIGH", "VND_JPY": "3-MEDIUM"}
SIDE_PRIORITY = "5-LOW"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(col: str):
    """Money as an integer number of cents.

    The reference's prices are whole yen (integers); money columns of the driver
    tables have two decimals, so they become exact integers here.  Sums of integers
    are exact, which makes every mean reproducible to the last bit in any engine.
    """
    return F.round(F.col(col) * 100).cast("long")


def price_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(Date, price) of every line item: what the price statistics need, without the part join."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.to_date("l_shipdate").alias("Date"), cents("l_extendedprice").alias("price"))


def item_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, l_linenumber, Date, name, price, category) — one row per line item.

    The join with ``part`` is left to Catalyst/AQE: ``part`` grows with the scale
    factor, so it is not hinted as broadcast; AQE converts the join at run time when
    the measured size allows.
    """
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice")
    pa = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    return (li.join(pa, li.l_partkey == pa.p_partkey, "inner")
            .select("l_orderkey", "l_linenumber",
                    F.to_date("l_shipdate").alias("Date"),
                    F.col("p_name").alias("name"),
                    cents("l_extendedprice").alias("price"),
                    F.col("p_brand").alias("category")))


def daily_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 on the facts: mean price per ship date (null dates dropped, as pandas does)."""
    li = table(spark, sf_dir, "lineitem").select("l_shipdate", "l_extendedprice")
    return (li.select(F.to_date("l_shipdate").alias("Date"), cents("l_extendedprice").alias("price"))
            .where(F.col("Date").isNotNull())
            .groupBy("Date").agg(F.avg("price").alias("price")))


def rate_series(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One daily close series (Date, <name>) — the analogue of one FX file."""
    o = table(spark, sf_dir, "orders").select("o_orderdate", "o_totalprice", "o_orderpriority")
    return (o.where(F.col("o_orderpriority") == RATE_SERIES[name])
            .groupBy(F.to_date("o_orderdate").alias("Date"))
            .agg((F.avg(cents("o_totalprice")) / 100.0).alias(name)))


def rates_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1 over the three series: (Date, CNY_JPY, PHP_JPY, VND_JPY), nulls where a series has no day."""
    return full_outer_on([rate_series(spark, sf_dir, n) for n in RATE_SERIES], "Date", unique_keys=True)


def rates_wide_one_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same table as ``rates_wide`` from a single scan and a single grouped shuffle.

    A day appears when at least one of the three priorities has an order; a series
    with no order that day averages to null — exactly the full outer join.
    """
    o = table(spark, sf_dir, "orders").select("o_orderdate", "o_totalprice", "o_orderpriority")
    return (o.where(F.col("o_orderpriority").isin(*RATE_SERIES.values()))
            .groupBy(F.to_date("o_orderdate").alias("Date"))
            .agg(*[(F.avg(F.when(F.col("o_orderpriority") == p, cents("o_totalprice"))) / 100.0).alias(n)
                   for n, p in RATE_SERIES.items()]))


def side_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(year, month, Gasoline): monthly mean of the side series."""
    o = table(spark, sf_dir, "orders").select("o_orderdate", "o_totalprice", "o_orderpriority")
    return (o.where(F.col("o_orderpriority") == SIDE_PRIORITY)
            .groupBy(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"))
            .agg((F.avg(cents("o_totalprice")) / 100.0).alias("Gasoline")))


def weekly_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(year 2-digit, month, week, price) of the weekly items: no part join."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        *_week_key(F.col("o_orderdate")), F.format_number(cents("l_extendedprice"), 0).alias("price"))


def _week_key(d) -> list:
    return [(F.year(d) - 1995 + 14).alias("year"), F.month(d).alias("month"),
            F.least(F.lit(4), F.ceil(F.dayofmonth(d) / 7).cast("int")).alias("week")]


def weekly_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items keyed like the scraped weekly files: (year 2-digit, month, week, name, price, category).

    year = year(o_orderdate) - 1995 + 14, week = least(4, ceil(day / 7)); price is kept
    as the string the files hold: whole units with thousands separators (``1,200``).
    """
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey",
                                                 "l_extendedprice")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    pa = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(pa, li.l_partkey == pa.p_partkey)
    return j.select(
        "l_orderkey", "l_linenumber", *_week_key(F.col("o_orderdate")),
        F.col("p_name").alias("name"),
        F.format_number(cents("l_extendedprice"), 0).alias("price"),
        F.col("p_brand").alias("category"),
    )
