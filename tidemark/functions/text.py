"""Text helpers.  All Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's for identical results:
# the URL pattern of the link extractor (the class [$-_@.&+] is a *range* from
# '$' to '_', so '/', ':', '?', '=' match while '#' and '~' end a URL),
# the restock marker, the currency suffix and the price/count label.
URL_PATTERN = r"http[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\\(\\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+"
RESTOCK_TEXT = "再入荷"
YEN_SUFFIX = "円"
MEAN_COUNT_LABEL = "%.1f円\n(%d件)"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lower_tokens(arr) -> Column:
    """lower-case every token of an array."""
    return F.transform(_c(arr), lambda x: F.lower(x))


def find_urls(c, pattern: str = URL_PATTERN) -> Column:
    """every URL in a text cell, in order of appearance."""
    return F.regexp_extract_all(_c(c), F.lit(pattern), 0)


def basename(path) -> Column:
    """last path component (``[^\\\\/]+$``)."""
    return F.regexp_extract(_c(path), r"[^\\/]+$", 0)


def drop_blank_lines(c) -> Column:
    """F16: remove lines that hold only whitespace (Unicode-aware)."""
    from .clean import USPACE
    lines = F.split(_c(c), "\n")
    non_space = "[^" + USPACE[1:-1] + "]"
    return F.array_join(F.filter(lines, lambda l: l.rlike(non_space)), "\n")


def after_equals(url) -> Column:
    """the piece after the first ``=`` (``split(url, "=")[1]``); null when absent."""
    return F.get(F.split(_c(url), "="), 1)


def is_restock(c) -> Column:
    """text equal to the restock marker → true; missing or other → false."""
    return F.coalesce(_c(c) == F.lit(RESTOCK_TEXT), F.lit(False))


def before_yen(c) -> Column:
    """text before the currency suffix."""
    return F.split(_c(c), YEN_SUFFIX).getItem(0)


def safe_sheet_name(c) -> Column:
    """``/`` and ``\\`` become ``_``."""
    return F.translate(_c(c), "/\\", "__")


def ratio_pct(part, whole) -> Column:
    """part / whole × 100, null on a zero whole."""
    return F.try_divide(_c(part).cast("double"), _c(whole).cast("double")) * 100.0


def mean_count_label(mean, count) -> Column:
    """``"{mean:.1f}円\\n({count}件)"``."""
    return F.format_string(MEAN_COUNT_LABEL, _c(mean).cast("double"), _c(count).cast("long"))


def whitespace_fields(c) -> Column:
    """Strip, then split on runs of Unicode whitespace (Python ``str.split()``)."""
    from .clean import USPACE, ustrip
    return F.split(ustrip(_c(c)), USPACE + "+")
