"""Folder ingest with per-file layout dispatch.

A folder holds survey files of three layouts, told apart by the file name.  Each
layout says how many preamble lines to skip, which column holds the price and which
cell (row, column) holds the survey month, written three different ways.  The whole
folder is one scan: records are numbered (``records``), the layout chosen per file
with ``when``, the price and date cells picked with column arithmetic, and one
``groupBy(file)`` gives the per-file mean.  Files that cannot be read into a
(year, month) are reported in an errors table instead of stopping the job.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clean import to_number
from ..functions.dates import fixed_year_month, heisei_year_month, split_year_month
from .delimited import _cells
from .records import records_of


@dataclass(frozen=True)
class Layout:
    name: str
    skip: int        # preamble lines; line ``skip`` (0-based) is read as the header
    price_col: int   # 0-based column of the price
    date_row: int    # 0-based (row, column) of the survey-month cell
    date_col: int
    date_form: str   # 'kanji' 2021年2月 | 'fixed' YYYY??MM | 'heisei' 平成28年12月


# Fixed values that must equal the reference's: the three survey layouts.
LAYOUTS = (
    Layout("b", skip=10, price_col=13, date_row=10, date_col=8, date_form="kanji"),
    Layout("gsb", skip=8, price_col=7, date_row=8, date_col=1, date_form="fixed"),
    Layout("gs", skip=15, price_col=2, date_row=10, date_col=2, date_form="heisei"),
)


def layout_of(file: Column) -> Column:
    """Dispatch on the file name: starts with 'b' → b; contains 'gsb' → gsb; contains 'gs' → gs."""
    return (F.when(file.startswith("b"), F.lit("b"))
            .when(file.contains("gsb"), F.lit("gsb"))
            .when(file.contains("gs"), F.lit("gs")))


def _by_layout(attr: str) -> Column:
    out = None
    for lay in LAYOUTS:
        cond = F.col("layout") == lay.name
        v = F.lit(getattr(lay, attr))
        out = F.when(cond, v) if out is None else out.when(cond, v)
    return out


def survey_files(spark: SparkSession, path, name_col: str | None = None) -> DataFrame:
    """One row per recognised file: its layout, means and date cell, year and month (null when
    the cell can't be read)."""
    width = max(max(lay.price_col, lay.date_col) for lay in LAYOUTS) + 1
    return _survey_files(spark, path, name_col, width)


def read_survey_folder(spark: SparkSession, path, name_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(path, file, layout, year, month, price_mean, n_prices, price_sum) per
    readable file, plus (path, file, layout, reason) for files that fail."""
    per_file = survey_files(spark, path, name_col)
    ok = readable()
    rows = per_file.where(ok).select("path", "file", "layout", "year", "month", "price_mean", "n_prices",
                                     "price_sum")
    errors = per_file.where(~ok).select(
        "path", "file", "layout",
        F.when(F.col("date_cell").isNull(), F.lit("date cell missing"))
        .otherwise(F.concat(F.lit("bad date cell: "), F.col("date_cell"))).alias("reason"))
    return rows, errors


def readable() -> Column:
    """Whether a row of ``survey_files`` has a year and a month."""
    return F.coalesce(F.col("year").isNotNull() & F.col("month").between(1, 12), F.lit(False))


def _survey_files(spark: SparkSession, path, name_col: str | None, width: int) -> DataFrame:
    ln = records_of(spark, path, name_col)
    ln = ln.withColumn("layout", layout_of(F.col("file"))).where(F.col("layout").isNotNull())
    ln = ln.withColumns({a: _by_layout(a) for a in ("skip", "price_col", "date_row", "date_col")})
    fields = _cells(F.col("line"), width)
    arr = F.array(*[fields.getField(f"c{i}") for i in range(width)])
    ln = ln.withColumn("_cells", arr)
    cell = lambda idx: F.element_at(F.col("_cells"), idx + F.lit(1))
    is_data = (F.col("pos") > F.col("skip")) & (F.length(F.trim("line")) > 0)
    price = F.when(is_data, to_number(cell(F.col("price_col"))))
    date_cell = F.when(F.col("pos") == F.col("date_row"), cell(F.col("date_col")))
    per_file = ln.groupBy("path", "file", "layout").agg(
        F.avg(price).alias("price_mean"), F.count(price).alias("n_prices"),
        F.sum(price).alias("price_sum"), F.max(date_cell).alias("date_cell"))
    y_k, m_k = split_year_month(F.col("date_cell"))
    y_f, m_f = fixed_year_month(F.col("date_cell"))
    y_h, m_h = heisei_year_month(F.col("date_cell"))
    pick = lambda k, f, h: (F.when(F.col("layout") == "b", k)
                            .when(F.col("layout") == "gsb", f).otherwise(h))
    return per_file.withColumns({"year": pick(y_k, y_f, y_h), "month": pick(m_k, m_f, m_h)})


def ingest_tally(files: DataFrame) -> DataFrame:
    """Success / error counts of a folder job, from ``survey_files`` in one pass."""
    return files.groupBy(F.when(readable(), "ok").otherwise("error").alias("status")).agg(F.count(F.lit(1)).alias("files"))
