"""Order statistics of doubles by selection in digits, for all groups and ranks at once.

The first digit of a number is its sign and its logarithm to 1/``STEPS`` of an octave; infinities, zero and the
smallest numbers have digits of their own.  A pass counts, per group, the values of each digit and keeps their least and
greatest value; a running count over the digits (no more than numbers have) tells every wanted rank its digit.  Where a
digit holds different values, the next pass cuts the range between its least and greatest into ``CELLS`` equal cells and
goes on the same way, until a rank's cell holds one distinct value.

All digits are monotone in the value, so ranks are exact.  The first digit leaves fewer than 2**45 different doubles
to a range and each pass divides it by ``CELLS``, so there are at most four passes whatever the values, their number or the
number of groups.  Values are never collected, and neither sorted nor moved while the open ranges (at most one for each rank
and group) are ``SMALL`` or fewer: each pass is then one aggregation behind a broadcast join with the ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

STEPS = 256
CELLS = 1 << 22
#: The column by which quantiles of several columns go: a number below 2**10, so that it fits into one long with a digit.
NUMBER, _NUMBER_BITS = "_number", 10

#: Open ranges that are broadcast (a few numbers each).  Not left to Spark: it joins few keys by a shuffle, and then
#: all values of a wanted digit meet in one task.
SMALL = 1 << 18

_INF = float("inf")
_TOP = 1 << 20


def first_digit(value) -> Column:
    """A whole number below 2**20 in size that never falls where the value rises (NaN and null are not allowed)."""
    v = F.col(value) if isinstance(value, str) else value
    a = F.abs(v)
    size = F.when(a == 0, F.lit(0)).when(a == _INF, F.lit(_TOP)).otherwise(F.floor((F.log2(a) + 1075.0) * float(STEPS)) + 1).cast("long")
    return F.when(v < 0, -size).otherwise(size)


def _cell(value: Column, lo: Column, hi: Column) -> Column:
    """Which cell of [lo, hi] a value lies in."""
    return F.floor((value - lo) / (hi - lo) * float(CELLS))


def _counted(h: DataFrame, keys: list) -> DataFrame:
    """Adds the count of all earlier digits of the same group and range."""
    w = Window.partitionBy(*keys).orderBy("_digit").rowsBetween(Window.unboundedPreceding, -1)
    return h.withColumn("_before", F.coalesce(F.sum("_c").over(w), F.lit(0).cast("long")))


def _counts() -> list[Column]:
    return [F.count(F.lit(1)).alias("_c"), F.min("value").alias("_lo"), F.max("value").alias("_hi")]


def _meet(values: DataFrame, ranges: DataFrame, keys: list) -> DataFrame:
    """Each value with the open ranges (keys..., _first, lo, hi) that it lies in; null groups are groups."""
    v = values.withColumn("_d", first_digit("value"))
    if keys == [NUMBER]:
        one = lambda digit, number: F.shiftleft(digit, _NUMBER_BITS).bitwiseOR(number.cast("long"))
        r = ranges.select(one(F.col("_first"), F.col(NUMBER)).alias("_r"), "_first", "lo", "hi")
        met = v.join(r, one(v["_d"], v[NUMBER]) == r["_r"]).drop("_r")
    else:
        r = ranges.select(*[F.col(k).alias(f"_r_{k}") for k in keys], F.col("_first"), "lo", "hi")
        same = v["_d"] == r["_first"]
        for k in keys:
            same = same & v[k].eqNullSafe(r[f"_r_{k}"])
        met = v.join(r, same).drop(*[f"_r_{k}" for k in keys])
    return met.where((F.col("value") >= F.col("lo")) & (F.col("value") <= F.col("hi"))).drop("_d")


def order_statistics(long: DataFrame, keys: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """(keys..., n, lo, targets): values of every group of ``long`` (keys..., value: neither null nor NaN) and what they are:
    ``targets`` lists (p, part) for the values at ranks floor and ceil (``part`` 0 and 1) of (n - 1) p, ``p`` being the
    number of the probability."""
    keys = list(keys)
    values = long.select(*keys, "value")
    h = _counted(values.groupBy(*keys, first_digit("value").alias("_digit")).agg(*_counts()), keys)
    h = h.withColumn("n", F.sum("_c").over(Window.partitionBy(*keys))).withColumn("_first", F.col("_digit"))
    place = [(F.col("n") - 1) * F.lit(float(p)) for p in probs]
    wanted = F.array(*[F.struct(F.lit(i).alias("p"), F.lit(part).alias("part"), (F.ceil(x) if part else F.floor(x)).alias("rank"))
                       for i, x in enumerate(place) for part in (0, 1)])

    def hit(h: DataFrame, targets: Column) -> DataFrame:
        """The digits that hold wanted ranks, with these."""
        before = F.col("_before")
        here = F.filter(targets, lambda t: (t["rank"] >= before) & (t["rank"] < before + F.col("_c")))
        own = F.transform(here, lambda t: F.struct(t["p"].alias("p"), t["part"].alias("part"), (t["rank"] - before).alias("rank")))
        return cut_lineage(h.withColumn("_t", own).where(F.size("_t") > 0).select(
            *keys, "n", "_first", F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), F.col("_t").alias("targets")))

    found = hit(h, wanted)
    done = []
    while n_open := (open_ := found.where("lo < hi")).count():
        done.append(found.where("lo = hi"))
        if n_open <= SMALL:
            open_ = F.broadcast(open_)
        inside = _meet(values, open_, keys)
        ranges = [*keys, "_first", "lo", "hi"]
        h = inside.groupBy(*ranges, _cell(F.col("value"), F.col("lo"), F.col("hi")).alias("_digit")).agg(*_counts())
        r = open_.select(*[F.col(c).alias(f"_r_{c}") for c in ranges], "n", "targets")
        same = F.lit(True)
        for c in ranges:
            same = same & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
        h = _counted(h, ranges).join(r, same).drop(*[f"_r_{c}" for c in ranges])
        found = hit(h, F.col("targets"))
    for d in done:
        found = found.union(d)
    return found.select(*keys, "n", "lo", "targets")


def between(lo: Column, hi: Column, share: Column) -> Column:
    """Linear interpolation that also holds where the distance overflows; null between opposite infinities."""
    far = F.abs(hi - lo) == _INF
    mixed = F.nanvl(lo * (1.0 - share) + hi * share, F.lit(None).cast("double"))
    return F.when((lo == hi) | (share == 0.0), lo).when(far, mixed).otherwise(lo + (hi - lo) * share)


def select_quantiles(long: DataFrame, keys: Sequence[str], probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """(keys..., n, names...): quantiles with linear interpolation of every group."""
    at = order_statistics(long, keys, probs).select(*keys, "n", "lo", F.explode("targets").alias("_t"))
    side = lambda i, part: F.max(F.when((F.col("_t.p") == i) & (F.col("_t.part") == part), F.col("lo")))
    both = at.groupBy(*keys, "n").agg(*[side(i, part).alias(f"_{i}_{part}") for i in range(len(probs)) for part in (0, 1)])
    share = [(F.col("n") - 1) * F.lit(float(p)) - F.floor((F.col("n") - 1) * F.lit(float(p))) for p in probs]
    return both.select(*keys, "n", *[between(F.col(f"_{i}_0"), F.col(f"_{i}_1"), share[i]).alias(nm) for i, nm in enumerate(names)])
