"""Ordered operators per group, with a null group key, cut into many buckets.

The same operators run in one bucket on small inputs; here the bucket count is given, so that
the carries across bucket edges and the null group are part of what is compared.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import align as AL
from ..operators import models as M
from ..operators import stats as ST
from . import sqlkit as Q
from . import tables as TB
from .catalog import query, rnd

BUCKETS = 7


def _series(spark, sf_dir):
    """(grp, Date, v): daily mean order value per priority; 1-URGENT has no group key, and every
    third day of a month no value."""
    o = TB.table(spark, sf_dir, "orders")
    grp = F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_orderpriority")).alias("grp")
    d = o.groupBy(grp, F.to_date("o_orderdate").alias("Date")).agg((F.avg(TB.cents("o_totalprice")) / 100.0).alias("v"))
    return d.withColumn("v", F.when(F.dayofmonth("Date") % 3 != 0, F.col("v")))


_S = (f"WITH s AS (SELECT CASE WHEN o_orderpriority <> '1-URGENT' THEN o_orderpriority END AS grp, "
      f"CAST(o_orderdate AS DATE) AS Date, CASE WHEN day(CAST(o_orderdate AS DATE)) % 3 <> 0 "
      f"THEN avg({Q.cents('o_totalprice')}) / 100.0 END AS v FROM orders GROUP BY 1, 2)")


def _filled(direction: str) -> str:
    if direction == "f":
        return "last_value(v IGNORE NULLS) OVER (PARTITION BY grp ORDER BY Date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return "first_value(v IGNORE NULLS) OVER (PARTITION BY grp ORDER BY Date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


@query("w1_fill_forward_null_group", _S + f" SELECT grp, Date, {_filled('f')} AS v FROM s")
def w1_fill_forward_null_group(spark, sf_dir):
    return AL.fill_forward(_series(spark, sf_dir), "Date", by=["grp"], buckets=BUCKETS)


@query("w2_fill_backward_null_group", _S + f" SELECT grp, Date, {_filled('b')} AS v FROM s")
def w2_fill_backward_null_group(spark, sf_dir):
    return AL.fill_backward(_series(spark, sf_dir), "Date", by=["grp"], buckets=BUCKETS)


@query("w3_pct_change_null_group",
       _S + f", f AS (SELECT grp, Date, {_filled('f')} AS v FROM s) SELECT grp, Date, "
       "round((v / lag(v) OVER (PARTITION BY grp ORDER BY Date) - 1) * 100, 9) AS v FROM f")
def w3_pct_change_null_group(spark, sf_dir):
    return rnd(AL.pct_change(_series(spark, sf_dir), "Date", by=["grp"], buckets=BUCKETS), {"v": 9})


_QUANTILES = _S + (" SELECT grp, 'v' AS variable, count(v) AS n, " + ", ".join(
    f"round(quantile_cont(v, {p}), 4) AS q{int(p * 100)}" for p in (0.25, 0.5, 0.75)) + " FROM s WHERE v IS NOT NULL GROUP BY grp")


@query("a8_rank_null_group", _QUANTILES)
def a8_rank_null_group(spark, sf_dir):
    q = ST.quantiles(_series(spark, sf_dir), ["v"], [0.25, 0.5, 0.75], by=["grp"], method="rank", buckets=BUCKETS)
    return rnd(q, {c: 4 for c in ("q25", "q50", "q75")})


@query("a8_select_null_group", _QUANTILES)
def a8_select_null_group(spark, sf_dir):
    q = ST.quantiles(_series(spark, sf_dir), ["v"], [0.25, 0.5, 0.75], by=["grp"], method="select")
    return rnd(q, {c: 4 for c in ("q25", "q50", "q75")})


@query("a14_box_null_group",
       _S + ", q AS (SELECT grp, count(v) AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, "
       "quantile_cont(v, 0.75) AS q3 FROM s WHERE v IS NOT NULL GROUP BY grp) "
       "SELECT q.grp, q.n, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, "
       "round(min(v) FILTER (WHERE v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1)), 4) AS whisker_lo, "
       "round(max(v) FILTER (WHERE v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1)), 4) AS whisker_hi, "
       "count(*) FILTER (WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS n_outliers "
       "FROM s JOIN q ON s.grp IS NOT DISTINCT FROM q.grp WHERE v IS NOT NULL GROUP BY q.grp, q.n, q1, median, q3")
def a14_box_null_group(spark, sf_dir):
    b = ST.box_stats(_series(spark, sf_dir), "v", by=["grp"])
    return rnd(b, {c: 4 for c in ("q1", "median", "q3", "whisker_lo", "whisker_hi")})


@query("m4_rank_null_group",
       _S + " SELECT grp, Date, row_number() OVER (PARTITION BY grp ORDER BY Date) - 1 AS _rank, "
       "count(*) OVER (PARTITION BY grp) AS _n FROM s")
def m4_rank_null_group(spark, sf_dir):
    s = _series(spark, sf_dir).select("grp", "Date")
    return M.global_rank(s, "Date", by=["grp"], buckets=BUCKETS)


@query("j2_nearest_null_group",
       _S + ", r AS (SELECT grp, Date AS rd, v AS rv FROM s WHERE day(Date) % 5 = 1), "
       "u AS (SELECT grp, Date AS d, NULL::DATE AS rd, v FROM s UNION ALL SELECT grp, rd, rd, NULL FROM r), "
       "n AS (SELECT *, max(rd) OVER (PARTITION BY grp ORDER BY d RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p, "
       "min(rd) OVER (PARTITION BY grp ORDER BY d RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS f FROM u), "
       "m AS (SELECT grp, d, v, CASE WHEN f IS NULL THEN p WHEN p IS NULL THEN f WHEN d - p <= f - d THEN p ELSE f END AS k "
       "FROM n WHERE rd IS NULL) "
       "SELECT m.grp, m.d AS Date, m.v, r.rv FROM m LEFT JOIN r ON r.grp IS NOT DISTINCT FROM m.grp AND r.rd = m.k")
def j2_nearest_null_group(spark, sf_dir):
    s = _series(spark, sf_dir)
    r = s.where(F.dayofmonth("Date") % 5 == 1).select("grp", "Date", F.col("v").alias("rv"))
    return AL.asof_nearest(s, r, "Date", by=["grp"], buckets=BUCKETS)


@query("p1_number_texts",
       "SELECT k, count(*) AS n, count(x) AS n_read, round(sum(x), 4) AS total FROM (SELECT l_orderkey % 8 AS k, "
       "CASE WHEN regexp_full_match(t, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN CAST(t AS DOUBLE) END AS x FROM ("
       "SELECT l_orderkey, CASE l_orderkey % 8 WHEN 0 THEN 'NaN' WHEN 1 THEN q || 'd' WHEN 2 THEN q || 'f' WHEN 3 THEN '0x1p3' "
       "WHEN 4 THEN q WHEN 5 THEN '.' || q WHEN 6 THEN q || '.' ELSE q || 'e2' END AS t "
       "FROM (SELECT l_orderkey, CAST(l_linenumber AS VARCHAR) AS q FROM lineitem))) GROUP BY k")
def p1_number_texts(spark, sf_dir):
    """Number texts that Java's parser takes and pandas does not, beside plain ones."""
    from ..functions import clean as CL
    q = F.col("l_linenumber").cast("string")
    forms = [F.lit("NaN"), F.concat(q, F.lit("d")), F.concat(q, F.lit("f")), F.lit("0x1p3"), q,
             F.concat(F.lit("."), q), F.concat(q, F.lit(".")), F.concat(q, F.lit("e2"))]
    k = F.col("l_orderkey") % 8
    text = forms[-1]
    for i, f in enumerate(forms[:-1]):
        text = F.when(k == i, f).otherwise(text)
    t = TB.table(spark, sf_dir, "lineitem").select(k.alias("k"), CL.to_number(text).alias("x"))
    return rnd(t.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count("x").alias("n_read"), F.sum("x").alias("total")), {"total": 4})


@query("p3_unpadded_dates",
       "SELECT CAST(o_orderdate AS DATE) AS Date, count(*) AS n FROM orders GROUP BY 1")
def p3_unpadded_dates(spark, sf_dir):
    """Dates written without leading zeros are read like padded ones."""
    from ..functions import clean as CL
    d = F.col("o_orderdate")
    text = F.concat_ws("-", F.year(d).cast("string"), F.month(d).cast("string"), F.dayofmonth(d).cast("string"))
    return TB.table(spark, sf_dir, "orders").groupBy(CL.to_date_lenient(text).alias("Date")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------------------
# events: keys as fine as the rows, and one that a third of the rows share

_HOT = "TIMESTAMP '2024-01-15 12:00:00'"
_EVENTS = (f"WITH l AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN {_HOT} ELSE ts END AS ts, event_type FROM events WHERE event_type <> 'purchase'),\n"
           "p AS (SELECT ts, min(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY ts),\n"
           "u AS (SELECT event_id, ts AS k, event_type, CAST(NULL AS TIMESTAMP) AS r FROM l UNION ALL SELECT NULL, ts, NULL, ts FROM p),\n"
           "n AS (SELECT *, max(r) OVER (ORDER BY k RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b, "
           "min(r) OVER (ORDER BY k RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM u),\n"
           "m AS (SELECT event_id, event_type, CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a WHEN k - b <= a - k THEN b ELSE a END AS r "
           "FROM n WHERE event_id IS NOT NULL)\n")


def _hot_events(spark, sf_dir):
    e = TB.table(spark, sf_dir, "events")
    left = e.where("event_type <> 'purchase'").select(
        "event_id", F.when(F.col("event_id") % 3 == 0, F.lit("2024-01-15 12:00:00").cast(e.schema["ts"].dataType)).otherwise(F.col("ts")).alias("ts"), "event_type")
    return left, e.where("event_type = 'purchase'").select("ts", "value")


@query("j2_nearest_events_hot_key", _EVENTS + "SELECT m.event_id, m.event_type, p.value FROM m JOIN p ON p.ts = m.r")
def j2_nearest_events_hot_key(spark, sf_dir):
    """Every other event's nearest purchase; a third of the events share one instant, which is split over buckets."""
    left, right = _hot_events(spark, sf_dir)
    out = AL.asof_nearest(left, right, "ts", payload=["value"], right_order=["value"], buckets=3 * BUCKETS)
    return out.select("event_id", "event_type", "value")


@query("w2_fill_backward_events",
       "SELECT event_id, first_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (ORDER BY ts, event_id "
       "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value FROM events")
def w2_fill_backward_events(spark, sf_dir):
    """The next purchase's value at every event, in one pass over each bucket."""
    e = TB.table(spark, sf_dir, "events").select("ts", "event_id", F.when(F.col("event_type") == "purchase", F.col("value")).alias("value"))
    return AL.fill_backward(e, ["ts", "event_id"], ["value"], buckets=BUCKETS).select("event_id", "value")
