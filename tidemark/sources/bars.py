"""Daily OHLCV bars from a tick table.

The reference downloads daily bars for one currency pair over ``[start, end)``.
Here the bars are built from stored ticks: one grouped aggregation per (key, day)
with ``min_by``/``max_by`` ordered by (timestamp, tick id) for open and close, so a
day's ticks are reduced map-side before the shuffle and no day is ever sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_bars(ticks: DataFrame, key: str, ts: str, value: str, tick_id: str,
               start: str | None = None, end: str | None = None) -> DataFrame:
    """(key, Date, Open, High, Low, Close, Volume) for ticks with start ≤ ts < end."""
    t = ticks.select(key, ts, value, tick_id)
    ts_type = ticks.schema[ts].dataType  # bounds in the column's own type (no zone shift)
    if start is not None:
        t = t.where(F.col(ts) >= F.lit(start).cast(ts_type))
    if end is not None:
        t = t.where(F.col(ts) < F.lit(end).cast(ts_type))
    order = F.struct(F.col(ts), F.col(tick_id))
    return (t.groupBy(key, F.to_date(ts).alias("Date"))
            .agg(F.min_by(value, order).alias("Open"), F.max(value).alias("High"),
                 F.min(value).alias("Low"), F.max_by(value, order).alias("Close"),
                 F.count(value).alias("Volume")))
