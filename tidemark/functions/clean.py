"""Lenient casts, predicates and column-set helpers.

All are Column expressions or thin DataFrame transforms; nothing leaves the JVM.
Spark 4 runs in ANSI mode, so every cast the reference made leniently
(``errors="coerce"``) is a ``try_*`` form here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Python's str.strip()/split() treat these as spaces (U+3000 ideographic space
# included); Java's \s and Spark's default trim() do not.  Fixed value: the characters
# for which Python's str.isspace() is true.
PY_WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003"
                 "\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
# The same set as a regex character class (Java and RE2 syntax).
USPACE = (r"[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
          r"\x{202F}\x{205F}\x{3000}]")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ustrip(c) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace (no regex)."""
    return F.trim(_c(c), F.lit(PY_WHITESPACE))


_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*([eE][+-]?[0-9]+)?|\.[0-9]+([eE][+-]?[0-9]+)?|(?i:inf|infinity))$"


def missing(df: DataFrame, col: str) -> Column:
    """Null, or NaN in a float column: the one rule of what is missing, as in pandas."""
    c = F.col(col)
    return (c.isNull() | F.isnan(c)) if isinstance(df.schema[col].dataType, (T.DoubleType, T.FloatType)) else c.isNull()


def nan_to_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The frame with null for the missing values of some columns, which every aggregate then leaves out."""
    kinds = {c: df.schema[c].dataType for c in dict.fromkeys(cols)}
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast(t)) for c, t in kinds.items()
                           if isinstance(t, (T.DoubleType, T.FloatType))})


def to_number(c, strip_commas: bool = False) -> Column:
    """Lenient number (``to_numeric(errors="coerce")``); bad text → null.

    With ``strip_commas`` thousands separators are removed first (``"1,200"`` → 1200),
    as two of the reference's scripts do; otherwise such text is null (Q2).
    """
    s = ustrip(_c(c).cast("string"))
    if strip_commas:
        s = F.replace(s, F.lit(","), F.lit(""))
    # only decimal text and infinities: Java's parser also takes "NaN", "1d" or "0x1p3"
    return F.when(s.rlike(_NUMBER), s.try_cast("double"))


def to_long(c, strip_commas: bool = True) -> Column:
    """``int(s.replace(",", ""))`` — integral text only; anything else → null."""
    s = ustrip(_c(c).cast("string"))
    if strip_commas:
        s = F.replace(s, F.lit(","), F.lit(""))
    return s.try_cast("long")


def to_date_lenient(c, fmt: str = "yyyy-M-d") -> Column:
    """``to_datetime(format=…, errors="coerce")`` — bad text, month or day → null."""
    return F.try_to_timestamp(_c(c).cast("string"), F.lit(fmt)).cast("date")


def to_date_strict(c) -> Column:
    """``to_datetime`` without coercion: a bad value raises (ANSI), as in the reference."""
    return F.to_date(_c(c))


def eq(c, value) -> Column:
    """P5 ``query('c == "x"')``: null never matches."""
    return _c(c) == F.lit(value)


def ne_keep_null(c, value) -> Column:
    """P5 ``query('c != "x"')``: pandas keeps null rows; SQL ``<>`` would drop them (Q5)."""
    return ~_c(c).eqNullSafe(F.lit(value))


def outside(c, lo, hi) -> Column:
    """Strictly below ``lo`` or strictly above ``hi``."""
    return (_c(c) < lo) | (_c(c) > hi)


def drop_nulls(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """``dropna(how="any", subset=…)``."""
    return df.dropna(how="any", subset=list(subset) if subset else None)


def fill_zero(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``fillna(0)`` on the given numeric columns."""
    df = nan_to_null(df, cols)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast(df.schema[c].dataType))
                           for c in cols})


def clip_col(c, lower, upper) -> Column:
    """``clip(lower, upper)``; ``greatest``/``least`` skip nulls and put NaN last, so both are guarded."""
    x = _c(c)
    out = x
    if upper is not None:
        out = F.least(F.lit(upper), out)
    if lower is not None:
        out = F.greatest(F.lit(lower), out)
    return F.when(x.eqNullSafe(F.lit(float("nan"))), x).when(x.isNotNull(), out)


def backup_columns(df: DataFrame, cols: Sequence[str], suffix: str = "_original") -> DataFrame:
    """P10: keep a copy of each column before it is transformed."""
    return df.withColumns({f"{c}{suffix}": F.col(c) for c in cols})


def drop_by_position(df: DataFrame, positions: Sequence[int]) -> DataFrame:
    """``drop(df.columns[[i, j]], axis=1)``."""
    names = [df.columns[i] for i in positions]
    return df.drop(*names)


def project_rename(df: DataFrame, mapping: dict[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """``df[[keep…, old…]].rename(columns={old: new})``."""
    return df.select(*keep, *[F.col(o).alias(n) for o, n in mapping.items()])


def rename_by_position(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``df.columns = [...]``."""
    return df.toDF(*names)


def value_band(c, bands: dict[str, tuple[float, float]]) -> Column:
    """Label each value with the first band [lo, hi] that contains it (else null)."""
    out = None
    for label, (lo, hi) in bands.items():
        cond = _c(c).between(F.lit(lo), F.lit(hi))
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out


def linear_trend(x, slope: float, intercept: float) -> Column:
    """Fitted line ``slope * x + intercept`` with the fit's literals."""
    return F.lit(float(slope)) * _c(x).cast("double") + F.lit(float(intercept))
