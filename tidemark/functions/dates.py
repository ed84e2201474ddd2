"""Calendar keys.

The reference turns scraped (2-digit year, month, week) keys into dates with three
different rules (Q1); all three are here behind one function with a ``rule``
parameter.  Every expression is built from Spark built-ins and returns null where
the reference's Python would have raised (bad month, day outside the month).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clean import USPACE


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_make_date(y, m, d) -> Column:
    """``make_date`` raises in ANSI mode on impossible parts; this returns null instead."""
    y, m, d = _c(y), _c(m), _c(d)
    ts = F.try_make_timestamp_ntz(y.cast("int"), m.cast("int"), d.cast("int"),
                                  F.lit(0), F.lit(0), F.lit(0))
    return ts.cast("date")


def first_monday(y, m) -> Column:
    f = safe_make_date(y, m, F.lit(1))
    return F.date_add(f, F.pmod(F.lit(7) - F.weekday(f), F.lit(7)))


def week_to_date(yy, month, week, rule: str = "first_monday", legacy_before: int = 18) -> Column:
    """(2-digit year, month, week) → date.

    ``rule="first_monday"`` (F1; F2 is ``legacy_before=2018``, which is always true for a
    2-digit year):  if yy < legacy_before and month < 7, day = 5 / 15 / 25 for week
    1 / 2 / other; else the first Monday of the month + 7·(week − 1) (may run into the
    next month).  Any null or impossible part gives null.

    ``rule="block"`` (F3 + F4): the same legacy branch (a null week falls to 25, as a
    NaN compares unequal to 1 and 2); otherwise a null week is day 1 and any other
    week is day min(7·(week − 1) + 1, 28).  A day below 1 gives null.
    """
    y, m, w = _c(yy).cast("int"), _c(month).cast("int"), _c(week).cast("int")
    legacy = (y < legacy_before) & (m < 7)
    legacy_day = F.when(w == 1, 5).when(w == 2, 15).otherwise(25)
    year4 = y + 2000
    if rule == "first_monday":
        modern = F.when(w.isNotNull(), F.date_add(first_monday(year4, m), (w - 1) * 7))
        legacy_date = F.when(w.isNotNull(), safe_make_date(year4, m, legacy_day))
        return F.when(y.isNull() | m.isNull(), F.lit(None).cast("date")) \
            .when(legacy, legacy_date).otherwise(modern)
    if rule == "block":
        day = (F.when(legacy, legacy_day)
               .when(w.isNull(), F.lit(1))
               .otherwise(F.least((w - 1) * 7 + 1, F.lit(28))))
        return safe_make_date(year4, m, day)
    raise ValueError(rule)



def days_since_epoch(d) -> Column:
    """``(date - 1970-01-01).days``."""
    return F.unix_date(_c(d))


def days_from(d, origin) -> Column:
    """days from an origin date (a literal from a one-row min aggregate)."""
    return F.datediff(_c(d), F.lit(origin).cast("date") if not isinstance(origin, Column) else origin)


def year_month(d) -> tuple[Column, Column]:
    """F7."""
    return F.year(_c(d)), F.month(_c(d))


def month_start(y, m) -> Column:
    """F8: first day of (year, month)."""
    return safe_make_date(y, m, F.lit(1))


def month_label(base, offset_days) -> Column:
    """date ``base + offset`` formatted as ``YYYY年MM月``."""
    return F.date_format(F.date_add(_c(base), _c(offset_days).cast("int")), "yyyy年MM月")


def tick_offsets(max_days, step: int = 180) -> Column:
    """tick positions 0, step, 2·step … up to and including the last needed one."""
    return F.sequence(F.lit(0), _c(max_days).cast("int") + F.lit(step - 1), F.lit(step))


def _int_piece(x: Column) -> Column:
    """Python ``int(piece)``: surrounding Unicode whitespace is ignored."""
    from .clean import ustrip
    return ustrip(x).try_cast("int")


def split_year_month(c) -> tuple[Column, Column]:
    """``2021年2月`` → (2021, 2) — split on 年/月, pieces 0 and 1."""
    parts = F.split(_c(c), "[年月]")
    return _int_piece(F.get(parts, 0)), _int_piece(F.get(parts, 1))


def heisei_year_month(c) -> tuple[Column, Column]:
    """``平成28年12月`` → (2016, 12).

    Split on 平, 成, 年, 月 and braces, drop empty pieces, lower-case (F13, no effect on
    digits); a year below 2000 is a Heisei year and gets +1988.
    """
    parts = F.filter(F.split(_c(c), "[{平成}年月]"), lambda x: x != "")
    parts = F.transform(parts, lambda x: F.lower(x))
    y = _int_piece(F.get(parts, 0))
    m = _int_piece(F.get(parts, 1))
    return F.when(y < 2000, y + 1988).otherwise(y), m


def fixed_year_month(c) -> tuple[Column, Column]:
    """year = characters 1–4, month = characters 7–8 (``date[0:4]``, ``date[6:8]``)."""
    s = _c(c)
    return _int_piece(F.substring(s, 1, 4)), _int_piece(F.substring(s, 7, 2))


__all__ = [n for n in dir() if not n.startswith("_")] + ["USPACE"]
