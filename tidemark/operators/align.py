"""Aligning irregular series on a key (a date, a timestamp or a number).

Operators (SURVEY §2.4, §2.6):

* ``full_outer_on``   J1  full outer equi-join of several keyed series
* ``fill_forward``    W1  last non-null value so far
* ``fill_backward``   W2  next non-null value
* ``fill_both``       W1 then W2 (pandas ``ffill().bfill()``)
* ``pct_change``      W3/W4 padded percentage change
* ``asof_nearest``    J2/J5 nearest-key join, exact match wins, ties go to the earlier key
* ``first_match``     J3 left lookup that keeps only the first right row per key

Scale design.  An ordered operator with no partition key would put every row on a
single task (``Window.orderBy`` without ``partitionBy``).  Instead rows are
bucketed by ranges of the order key (bounds from one approximate-quantile pass, so
buckets are balanced by rows and a hot group is split across them), the window runs
inside each (group, bucket), and what crosses a bucket edge (the last non-null
value of the buckets before, the first of the buckets after) is computed from a
per-bucket summary.  The summary has one row per (group, bucket); only it is windowed
globally, and it is joined back on the bucket id.  Fact rows are never collected and
never all meet in one task.
"""

from __future__ import annotations

import math
import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import nan_to_null
from pyspark.sql import types as T

_B = "_tm_bucket"
_K = "_tm_key"
_SIDE = "_tm_side"


def _as_list(x) -> list:
    if x is None:
        return []
    if isinstance(x, (str, Column)):
        return [x]
    return list(x)


def numeric_key(df: DataFrame, name: str) -> Column:
    """Order-preserving numeric image of a key column (days, microseconds or the number)."""
    dtype = df.schema[name].dataType
    c = F.col(name)
    if isinstance(dtype, T.DateType):
        return F.unix_date(c).cast("long")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        if isinstance(dtype, T.TimestampNTZType):
            # wall-clock fields, so that no session zone's clock changes reorder keys
            seconds = F.hour(c) * 3600 + F.minute(c) * 60
            return (F.unix_date(c.cast("date")).cast("long") * 86_400_000_000 + seconds.cast("long") * 1_000_000
                    + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long"))
        return F.unix_micros(c)
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return c.cast("long")
    return c.cast("double")


# Target rows per range bucket of the ordered operators (override for experiments).
ROWS_PER_BUCKET = int(os.environ.get("TIDEMARK_ROWS_PER_BUCKET", "1000000"))


def range_buckets(df: DataFrame, by: Sequence[str], order: Sequence[str],
                  buckets: int | None = None, rows_per_bucket: int | None = None) -> DataFrame:
    """Tag each row with a range bucket of its primary order key.

    The number of buckets follows the rows: ceil(rows / ``rows_per_bucket``), or just
    ``buckets`` when given.  One aggregation returns the matching approximate quantiles
    of the key as bounds; only those numbers reach the driver.  Buckets are contiguous
    and ascending (every key of bucket i sorts before every key of bucket i+1) and
    balanced by row count, but rows that share one key value share a bucket.  The bucket
    is a plain column expression, so the window that follows (partitioned by ``by`` and
    the bucket) costs exactly one hash shuffle, and a hot ``by`` group is split across
    buckets by key range.  A small input gets a single bucket, and the callers then skip
    the cross-bucket carry entirely.  Returns (frame, buckets).
    """
    order = _as_list(order)
    if not order or buckets == 1:
        return df.withColumn(_B, F.lit(0)), 1
    n = buckets or -(-df.count() // (rows_per_bucket or ROWS_PER_BUCKET))
    if n <= 1:
        return df.withColumn(_B, F.lit(0)), 1
    key = numeric_key(df, order[0]).cast("double")
    probs = F.array(*[F.lit(i / n) for i in range(1, n)])
    found = df.agg(F.percentile_approx(key, probs, 4 * n).alias("b")).first()["b"]
    bounds = sorted({float(b) for b in found or [] if b is not None})
    if not bounds:
        return df.withColumn(_B, F.lit(0)), 1
    return df.withColumn(_B, bucket_of(key, bounds)), len(bounds) + 1


def bucket_of(key: Column, bounds: Sequence[float]) -> Column:
    """Number of ``bounds`` (sorted) that are <= ``key``; a null key → 0.

    Up to 256 bounds are a balanced CASE tree (about log2(len(bounds)) comparisons inside
    generated code).  More are looked up in two steps, a block of bounds and a place in
    it, about 2 sqrt(len(bounds)) comparisons.
    """
    if len(bounds) > 256:
        size = math.isqrt(len(bounds)) + 1
        blocks = [list(bounds[i:i + size]) for i in range(0, len(bounds), size)]
        below = lambda a: F.coalesce(F.size(F.filter(a, lambda b: b <= key)), F.lit(0))
        block = F.greatest(below(F.lit([b[0] for b in blocks])) - 1, F.lit(0))
        inside = F.array(*[F.lit(b) for b in blocks])[block]
        return F.when(key.isNull(), F.lit(0)).otherwise(block * size + below(inside))

    def rec(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi + 1) // 2
        return F.when(key >= F.lit(bounds[mid - 1]), rec(mid, hi)).otherwise(rec(lo, mid - 1))
    return rec(0, len(bounds))


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on equal ``keys`` where null equals null: a null group is a group of its own in
    every operator, as it is in ``groupBy`` and ``partitionBy``.  The left keys stay."""
    keys = list(keys)
    r = right.withColumnsRenamed({k: f"_tm_r_{k}" for k in keys})
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(r[f"_tm_r_{k}"])
    return left.join(r, cond, how).drop(*[f"_tm_r_{k}" for k in keys])


def _join_back(df: DataFrame, carry: DataFrame, by: Sequence[str]) -> DataFrame:
    # carry has one row per (by, bucket); Spark/AQE choose broadcast or shuffle from
    # its measured size.
    return null_safe_join(df, carry, list(by) + [_B])


def _running(by: Sequence[str], order: Sequence[str], backward: bool = False):
    """All rows of the bucket up to the current one, from its first (or, backward, from its last) row.

    What follows a row is read in descending order, because a frame that ends at the bucket's last row is gone
    through again for every row.
    """
    keys = [F.desc(o) if backward else F.asc(o) for o in order]
    return Window.partitionBy(*by, _B).orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)


def _earlier(by: Sequence[str], backward: bool = False):
    """All buckets before (or, backward, after) the current one, of a table with one row per bucket."""
    return Window.partitionBy(*by).orderBy(F.desc(_B) if backward else F.asc(_B)).rowsBetween(Window.unboundedPreceding, -1)


def _fill(df: DataFrame, order: Sequence[str], cols: Sequence[str], by: Sequence[str],
          forward: bool, backward: bool, buckets: int | None) -> DataFrame:
    """Bucketed fill; with both directions the result is coalesce(forward, backward)."""
    order = _as_list(order)
    by = _as_list(by)
    cols = list(cols)
    df = nan_to_null(df, cols)
    b, nb = range_buckets(df, by, order, buckets)
    okey = F.struct(*[F.col(o) for o in order])
    inner, edge, carry_expr = {}, [], []
    if forward:
        wf = _running(by, order)
        inner.update({f"_tm_ff_{c}": F.last(c, ignorenulls=True).over(wf) for c in cols})
        edge += [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), okey)).alias(f"_tm_l_{c}")
                 for c in cols]
        carry_expr += [F.last(f"_tm_l_{c}", ignorenulls=True).over(_earlier(by)).alias(f"_tm_cf_{c}") for c in cols]
    if backward:
        wb = _running(by, order, backward=True)
        inner.update({f"_tm_bf_{c}": F.last(c, ignorenulls=True).over(wb) for c in cols})
        edge += [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), okey)).alias(f"_tm_f_{c}")
                 for c in cols]
        carry_expr += [F.last(f"_tm_f_{c}", ignorenulls=True).over(_earlier(by, backward=True)).alias(f"_tm_cb_{c}") for c in cols]
    out = b.withColumns(inner)
    if nb > 1:
        summary = b.groupBy(*by, _B).agg(*edge)
        carry = summary.select(*by, _B, *carry_expr)
        out = _join_back(out, carry, by)
    res = {}
    for c in cols:
        parts = []
        if forward:
            parts += [F.col(f"_tm_ff_{c}")] + ([F.col(f"_tm_cf_{c}")] if nb > 1 else [])
        if backward:
            parts += [F.col(f"_tm_bf_{c}")] + ([F.col(f"_tm_cb_{c}")] if nb > 1 else [])
        res[c] = F.coalesce(*parts)
    return out.withColumns(res).select(*df.columns)


def _value_cols(df: DataFrame, order, by, cols) -> list[str]:
    if cols is not None:
        return list(cols)
    skip = set(_as_list(order)) | set(_as_list(by))
    return [c for c in df.columns if c not in skip]


def fill_forward(df: DataFrame, order, cols=None, by=(), buckets: int | None = None) -> DataFrame:
    """Replace each null by the last non-null value before it in ``order``."""
    return _fill(df, order, _value_cols(df, order, by, cols), by, True, False, buckets)


def fill_backward(df: DataFrame, order, cols=None, by=(), buckets: int | None = None) -> DataFrame:
    """Replace each null by the next non-null value after it in ``order``."""
    return _fill(df, order, _value_cols(df, order, by, cols), by, False, True, buckets)


def fill_both(df: DataFrame, order, cols=None, by=(), buckets: int | None = None) -> DataFrame:
    """W1 then W2, i.e. pandas ``sort_values(order).ffill().bfill()``.

    After the forward fill only leading nulls remain and the backward fill gives
    them the first non-null value, so the result is coalesce(forward, backward),
    computed in one bucketed pass.
    """
    return _fill(df, order, _value_cols(df, order, by, cols), by, True, True, buckets)


def pct_change(df: DataFrame, order, cols=None, by=(), scale: float = 100.0,
               first_zero: bool = False, suffix: str | None = None,
               buckets: int | None = None) -> DataFrame:
    """Pandas ``pct_change()`` (nulls padded first) times ``scale``.

    value_t = f_t / f_{t-1} - 1 with f the forward-filled series.  A zero or null
    denominator gives null (pandas would give inf/NaN).  With ``first_zero`` every
    null result becomes 0 (the reference's ``fillna(0)``).  Results replace the
    columns unless ``suffix`` is given.
    """
    order = _as_list(order)
    by = _as_list(by)
    cols = _value_cols(df, order, by, cols)
    df = nan_to_null(df, cols)
    b, nb = range_buckets(df, by, order, buckets)
    okey = F.struct(*[F.col(o) for o in order])
    w = Window.partitionBy(*by, _B).orderBy(*order)
    wrun = w.rowsBetween(Window.unboundedPreceding, 0)
    filled = b.withColumns({f"_tm_f_{c}": F.last(c, ignorenulls=True).over(wrun) for c in cols})
    filled = filled.withColumns({f"_tm_p_{c}": F.lag(f"_tm_f_{c}", 1).over(w) for c in cols})
    if nb > 1:
        summary = b.groupBy(*by, _B).agg(*[
            F.max_by(F.col(c), F.when(F.col(c).isNotNull(), okey)).alias(c) for c in cols])
        ws = Window.partitionBy(*by).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
        carry = summary.select(*by, _B, *[F.last(c, ignorenulls=True).over(ws).alias(f"_tm_carry_{c}")
                                          for c in cols])
        out = _join_back(filled, carry, by)
    else:
        out = filled.withColumns({f"_tm_carry_{c}": F.lit(None).cast("double") for c in cols})
    res = {}
    for c in cols:
        cur = F.coalesce(F.col(f"_tm_f_{c}"), F.col(f"_tm_carry_{c}"))
        prev = F.coalesce(F.col(f"_tm_p_{c}"), F.col(f"_tm_carry_{c}"))
        v = (F.try_divide(cur, prev) - F.lit(1.0)) * F.lit(float(scale))
        if first_zero:
            v = F.coalesce(v, F.lit(0.0))
        res[(c + suffix) if suffix else c] = v
    out = out.withColumns(res)
    keep = list(df.columns) + ([k for k in res if k not in df.columns])
    return out.select(*keep)


def full_outer_on(frames: Sequence[DataFrame], on, unique_keys: bool = False) -> DataFrame:
    """Full outer equi-join of several series on ``on``.

    By default chained full outer joins, which form the products of duplicate keys.  With
    ``unique_keys`` the caller states that each input holds at most one row per key (as
    daily series do): the join is then a union and one grouped aggregation, one shuffle
    with map-side combining instead of one sort-merge join per input, and the query
    fails with a clear error where a key comes twice in one input.  Value columns must
    not repeat across inputs.
    """
    keys = _as_list(on)
    frames = list(frames)
    if not unique_keys:
        out = frames[0]
        for f in frames[1:]:
            out = out.join(f, keys, "full")
        return out
    value_cols: list[tuple[str, T.DataType]] = []
    for f in frames:
        for fld in f.schema.fields:
            if fld.name not in keys:
                value_cols.append((fld.name, fld.dataType))
    names = [n for n, _ in value_cols]
    if len(set(names)) != len(names):
        raise ValueError(f"value columns repeat across inputs: {names}")
    parts = []
    for i, f in enumerate(frames):
        own = set(f.columns)
        parts.append(f.select(
            *keys,
            *[(F.col(n) if n in own else F.lit(None).cast(t)).alias(n) for n, t in value_cols],
            F.lit(i).alias("_tm_src"),
        ))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    # max_by on the owning frame's rows keeps a legitimately null value null.
    aggs = []
    for n, _ in value_cols:
        owner = next(i for i, f in enumerate(frames) if n in f.columns)
        aggs.append(F.max(F.when(F.col("_tm_src") == owner, F.col(n))).alias(n))
    twice = [F.count_if(F.col("_tm_src") == i).alias(f"_tm_n{i}") for i in range(len(frames))]
    most = F.greatest(*[F.col(f"_tm_n{i}") for i in range(len(frames))], F.lit(0))
    checked = F.when(most > 1, F.raise_error(F.lit("full_outer_on: a key comes twice in one input"))).otherwise(F.lit(True))
    return u.groupBy(*keys).agg(*aggs, *twice).where(checked.cast("boolean")).select(*keys, *names)


def dedupe_first(df: DataFrame, keys, order=None) -> DataFrame:
    """One row per key: the first by ``order`` (a list of columns), else the smallest row.

    Implemented as a grouped ``min_by``/``min`` over a struct so it aggregates
    map-side; a hot key is reduced partially before the shuffle.
    """
    keys = _as_list(keys)
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.select(*keys).distinct()
    payload = F.struct(*[F.col(c) for c in rest])
    if order:
        agg = F.min_by(payload, F.struct(*[F.col(o) for o in _as_list(order)]))
    else:
        agg = F.min(payload)
    return df.groupBy(*keys).agg(agg.alias("_tm_row")).select(*keys, "_tm_row.*")


def nearest_key_map(left_keys: DataFrame, right_keys: DataFrame, by: Sequence[str],
                    buckets: int | None = None) -> DataFrame:
    """For distinct left keys ``_tm_key`` find the nearest distinct right key.

    Both inputs: ``(by..., _tm_key)`` numeric, distinct.  Output ``(by..., _tm_key,
    _tm_rkey)``; exact match first, otherwise the smaller distance, ties to the
    earlier right key; null when the group has no right key at all.
    """
    by = list(by)
    u = (left_keys.withColumn(_SIDE, F.lit(1))
         .unionByName(right_keys.withColumn(_SIDE, F.lit(0))))
    b, nb = range_buckets(u, by, [_K, _SIDE], buckets)
    rkey = F.when(F.col(_SIDE) == 0, F.col(_K))
    prev_in = F.last(rkey, ignorenulls=True).over(_running(by, [_K, _SIDE]))
    next_in = F.last(rkey, ignorenulls=True).over(_running(by, [_K, _SIDE], backward=True))
    cand = b.select(*by, _B, _K, _SIDE, prev_in.alias("_tm_pi"), next_in.alias("_tm_ni"))
    cand = cand.where(F.col(_SIDE) == 1)
    if nb > 1:
        summary = b.groupBy(*by, _B).agg(F.max(rkey).alias("_tm_last"), F.min(rkey).alias("_tm_first"))
        carry = summary.select(
            *by, _B, F.last("_tm_last", ignorenulls=True).over(_earlier(by)).alias("_tm_cprev"),
            F.last("_tm_first", ignorenulls=True).over(_earlier(by, backward=True)).alias("_tm_cnext"))
        cand = _join_back(cand, carry, by)
        prev = F.coalesce(F.col("_tm_pi"), F.col("_tm_cprev"))
        nxt = F.coalesce(F.col("_tm_ni"), F.col("_tm_cnext"))
    else:
        prev, nxt = F.col("_tm_pi"), F.col("_tm_ni")
    k = F.col(_K)
    choose = (F.when(nxt.isNull(), prev)
              .when(prev.isNull(), nxt)
              .when(k - prev <= nxt - k, prev)
              .otherwise(nxt))
    return cand.select(*by, _K, choose.alias("_tm_rkey"))


def _merge_buckets(u: DataFrame, salt: Column, buckets: int | None) -> tuple[DataFrame, int]:
    """Range buckets of ``_K`` for a merge: a key that many left rows share gets as many buckets as its share of the rows.

    Bounds are quantiles of the key; one that comes m times is a key of m buckets' rows.  Its right row (of which there
    is one) goes to the first of these, its left rows to any of them: what they need from the bucket before is carried.
    """
    n = buckets or -(-u.count() // ROWS_PER_BUCKET)
    if n <= 1:
        return u.withColumn(_B, F.lit(0)), 1
    key = F.col(_K).cast("double")
    found = u.agg(F.percentile_approx(key, F.array(*[F.lit(i / n) for i in range(1, n)]), 4 * n).alias("b")).first()["b"]
    bounds = sorted(float(b) for b in found or [] if b is not None)
    if not bounds:
        return u.withColumn(_B, F.lit(0)), 1
    bucket = bucket_of(key, bounds)
    hot = {b: bounds.count(b) for b in set(bounds) if bounds.count(b) > 1}
    if hot:
        many = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in hot.items() for x in kv]), key), F.lit(1))
        bucket = bucket - many + 1 + F.when(F.col(_SIDE) == 1, F.pmod(salt, many)).otherwise(0)
    return u.withColumn(_B, bucket.cast("int")), len(bounds) + 1


def _merge_nearest(left: DataFrame, right: DataFrame, by: Sequence[str], buckets: int | None) -> DataFrame:
    """The left rows (with ``_K``) and the columns of the right row (``_tm_rkey``: its key; one row per key) nearest to each.

    Both sides are put into range buckets together.  Inside a bucket the right row before and after each left row comes
    from two running windows; across bucket edges both come from a table with one row per bucket.  Rows
    move once and no key is looked up again.
    """
    by = list(by)
    own, theirs = [c for c in left.columns if c not in by], [c for c in right.columns if c not in by]
    row, hit = F.struct(*own), F.struct(F.col("_tm_rkey").alias("_tm_rkey"), *[c for c in theirs if c != "_tm_rkey"])
    l_type, r_type = left.select(row.alias("r")).schema["r"].dataType, right.select(hit.alias("r")).schema["r"].dataType
    u = left.select(*by, F.col(_K), F.lit(1).alias(_SIDE), row.alias("_tm_row"), F.lit(None).cast(r_type).alias("_tm_hit")).unionByName(
        right.where(F.col("_tm_rkey").isNotNull()).select(
            *by, F.col("_tm_rkey").alias(_K), F.lit(0).alias(_SIDE), F.lit(None).cast(l_type).alias("_tm_row"), hit.alias("_tm_hit")))
    # a struct's map can't be hashed; a key and the row's text tell rows apart well enough
    b, nb = _merge_buckets(u, F.xxhash64(F.to_json("_tm_row")), buckets)
    there = F.when(F.col(_SIDE) == 0, F.col("_tm_hit"))
    before = F.last(there, ignorenulls=True).over(_running(by, [_K, _SIDE]))
    after = F.last(there, ignorenulls=True).over(_running(by, [_K, _SIDE], backward=True))
    m = b.select(*by, _B, _K, _SIDE, "_tm_row", before.alias("_tm_p"), after.alias("_tm_n")).where(F.col(_SIDE) == 1)
    if nb > 1:
        place = F.when(F.col(_SIDE) == 0, F.col(_K))
        edges = b.groupBy(*by, _B).agg(F.max_by("_tm_hit", place).alias("_tm_last"), F.min_by("_tm_hit", place).alias("_tm_first"))
        carry = edges.select(*by, _B, F.last("_tm_last", ignorenulls=True).over(_earlier(by)).alias("_tm_cp"),
                             F.last("_tm_first", ignorenulls=True).over(_earlier(by, backward=True)).alias("_tm_cn"))
        m = _join_back(m, carry, by).withColumns({"_tm_p": F.coalesce("_tm_p", "_tm_cp"), "_tm_n": F.coalesce("_tm_n", "_tm_cn")})
    k, p, n = F.col(_K), F.col("_tm_p._tm_rkey"), F.col("_tm_n._tm_rkey")
    nearest = F.when(k.isNull(), F.lit(None).cast(r_type)).when(n.isNull() | (k - p <= n - k), F.col("_tm_p")).otherwise(F.col("_tm_n"))
    return m.withColumn("_tm_best", nearest).select(*by, "_tm_row.*", *[F.col(f"_tm_best.{c}").alias(c) for c in theirs])


def asof_nearest(left: DataFrame, right: DataFrame, on: str, right_on: str | None = None,
                 by=(), payload: Sequence[str] | None = None, right_order=None,
                 matched_as: str | None = None, buckets: int | None = None,
                 max_calendar_days: int = 1_000_000) -> DataFrame:
    """Attach to every left row the right row with the nearest key.

    * an exact key match wins; otherwise the smallest |distance|; a tie goes to the
      earlier right key (the reference scans a date-sorted table and keeps the first);
    * duplicate right keys: the first row by ``right_order`` (else the smallest row);
    * a matched right row with null payload still counts (no skipping of nulls);
    * left rows with a null key get null payload.

    Only keys enter the ordered step.  With date keys (and no ``by``), the mapping is
    built for every day of the right side's range (at most ``max_calendar_days`` rows,
    checked) and broadcast; the facts are scanned once.  Otherwise both sides are merged in range
    buckets of the key (``_merge_nearest``): one shuffle of the rows, one join with a table of bucket edges.
    """
    by = _as_list(by)
    rkey_name = right_on or on
    if payload is None:
        payload = [c for c in right.columns if c not in set(by) | {rkey_name}]
    payload = list(payload)
    r_cols = list(by) + [rkey_name] + payload
    r_order = _as_list(right_order)
    r = right.select(*r_cols, *[c for c in r_order if c not in r_cols])
    r = dedupe_first(r, by + [rkey_name], r_order or None).select(*r_cols)
    r = r.withColumn(_K, numeric_key(r, rkey_name))

    rk = r.select(*by, _K)
    rr = r.select(*by, F.col(_K).alias("_tm_rkey"), *[F.col(c) for c in payload],
                  *([F.col(rkey_name).alias(matched_as)] if matched_as else []))
    lo = left.withColumn(_K, numeric_key(left, on))

    dense = None
    if not by and isinstance(left.schema[on].dataType, T.DateType) \
            and isinstance(r.schema[rkey_name].dataType, T.DateType):
        span = rk.agg(F.min(_K).alias("lo"), F.max(_K).alias("hi")).first()
        if span["lo"] is not None and span["hi"] - span["lo"] < max_calendar_days:
            dense = (int(span["lo"]), int(span["hi"]))
    if dense is not None:
        # Calendar path: resolve every day of the right side's [first, last] range once
        # (a table whose size is the checked day count), and clamp left days into the
        # range — before the first right day the first one is nearest, after the last
        # the last one.  The facts are read once and meet the mapping in one
        # broadcast equi-join.
        d0, d1 = dense
        days = left.sparkSession.range(d0, d1 + 1).select(F.col("id").alias(_K))
        mapping = nearest_key_map(days, rk, [], 1 if d1 - d0 < 200_000 else None)
        clamped = F.when(F.col(_K).isNotNull(), F.least(F.greatest(F.col(_K), F.lit(d0)), F.lit(d1)))
        lo = lo.withColumn("_tm_kc", clamped)
        mapping = F.broadcast(mapping.withColumnRenamed(_K, "_tm_kc"))
        # the de-duplicated right side has at most one row per day of the same checked
        # range, so it is broadcast as well
        out = lo.join(mapping, ["_tm_kc"], "left").join(F.broadcast(rr), ["_tm_rkey"], "left")
    else:
        out = _merge_nearest(lo, rr, by, buckets)
    keep = list(left.columns) + payload + ([matched_as] if matched_as else [])
    return out.select(*keep)


def first_match(left: DataFrame, right: DataFrame, keys, payload: Sequence[str] | None = None,
                order=None, max_right_rows: int | None = None, default=None) -> DataFrame:
    """Left join that keeps only the first right row per key.

    A missing match gives null, or ``default`` when given (the reference uses both
    conventions).  With ``max_right_rows`` the caller states a bound on the distinct
    right keys (e.g. calendar months); it is checked with one count and, when it
    holds, the de-duplicated right side is broadcast so the left rows are never
    shuffled.
    """
    keys = _as_list(keys)
    if payload is None:
        payload = [c for c in right.columns if c not in keys]
    sel = keys + list(payload) + [c for c in _as_list(order) if c not in keys and c not in payload]
    r = dedupe_first(right.select(*sel), keys, order).select(*keys, *payload)
    if max_right_rows is not None and r.count() <= max_right_rows:
        r = F.broadcast(r)
    out = left.join(r, keys, "left")
    if default is not None:
        out = out.withColumns({c: F.coalesce(F.col(c), F.lit(default)) for c in payload})
    return out
