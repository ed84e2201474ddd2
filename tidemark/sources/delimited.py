"""Delimited-file sources.

* ``read_csv_strings``   S1 (+S3 projection, S4 rename): header CSV, every column a string
* ``read_with_preamble`` S2: files whose first N lines are a preamble (Spark's CSV
  reader cannot skip lines); records (a quoted field may hold line ends) come numbered from
  ``records`` and are parsed with ``from_csv``
* ``read_keyed_files``   S5: keys taken from the file name by a regex
* ``read_whitespace_text`` S9: whitespace-separated text, Unicode-aware split
* ``field_count_check``  A17: files whose rows do not all have the same field count
* ``extract_urls``       S10: every URL in one column of Shift_JIS CSV files

Large files are read by splits in all of them.
"""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clean import ustrip
from ..functions.text import find_urls, whitespace_fields
from .records import has_quoted_line_ends, records_of


def read_csv_strings(spark: SparkSession, path, names: Sequence[str] | None = None,
                     columns: Sequence | None = None, sep: str = ",",
                     encoding: str = "UTF-8", multi_line: bool = True) -> DataFrame:
    """``read_csv(path)`` with every value kept as text (casts come later, leniently).

    ``columns`` selects by name or position (``usecols``); ``names`` renames by position.
    Quoted fields may hold line ends and doubled quotes, as in pandas.  One scan looks for them: without any, Spark's reader
    parses line by line, and otherwise the records are put together first (``records``); large files are split
    either way.  With ``multi_line=False`` the caller states that there are none and the scan is saved.
    Only UTF-16 and UTF-32, where a quote's byte is part of other characters, are read file by file.
    """
    wide = encoding.upper().startswith(("UTF-16", "UTF-32"))
    if multi_line and not wide and has_quoted_line_ends(spark, path):
        df = _parsed_records(spark, path, sep, encoding)
    else:
        df = (spark.read.option("header", True).option("inferSchema", False).option("sep", sep)
              .option("encoding", encoding).option("mode", "PERMISSIVE").option("escape", '"').option("multiLine", wide).csv(path))
    if columns is not None:
        cols = [df.columns[c] if isinstance(c, int) else c for c in columns]
        df = df.select(*cols)
    if names is not None:
        df = df.toDF(*names)
    return df


def _parsed_records(spark: SparkSession, path, sep: str, encoding: str) -> DataFrame:
    """Header CSV files from their records; columns are named by the first file's header."""
    found = records_of(spark, path, encoding=None if encoding.upper() in ("UTF-8", "US-ASCII") else encoding)
    head = found.where("pos = 0").orderBy("path").first()
    names = next(csv.reader([head.line], delimiter=sep))
    seen = [n.lower() for n in names]
    names = [f"_c{i}" if not n else f"{n}{i}" if seen.count(n.lower()) > 1 else n for i, n in enumerate(names)]
    rows = found.where((F.col("pos") > 0) & (F.length(F.trim("line")) > 0))
    return rows.select(_cells(F.col("line"), len(names), sep).alias("_r")).select("_r.*").toDF(*names)


def _cells(line: Column, width: int, sep: str = ",") -> Column:
    """The first ``width`` fields c0, c1, … of a record; a quote inside a quoted field is doubled."""
    return F.from_csv(line, _csv_schema(width), {"sep": sep, "mode": "PERMISSIVE", "escape": '"'})


def _csv_schema(width: int) -> str:
    return ", ".join(f"c{i} STRING" for i in range(width))


def read_with_preamble(spark: SparkSession, path, skip: int, names: Sequence[str],
                       header: bool = True, sep: str = ",", name_col: str | None = None) -> DataFrame:
    """``read_csv(path, skiprows=skip)`` then ``df.columns = names``.

    Line ``skip`` (0-based) is the header when ``header`` (pandas' behaviour: a skip
    count one short of the preamble turns the last preamble line into the header,
    Q9), data rows follow it.  Blank lines are dropped like pandas does.  Output:
    ``file, line_no`` plus the named string columns.
    """
    ln = records_of(spark, path, name_col)
    first = skip + 1 if header else skip
    data = ln.where((F.col("pos") >= first) & (F.length(F.trim("line")) > 0))
    parsed = _cells(F.col("line"), len(names), sep)
    return data.select("file", F.col("pos").alias("line_no"), parsed.alias("_r")).select(
        "file", "line_no", *[F.col(f"_r.c{i}").alias(n) for i, n in enumerate(names)])


def read_keyed_files(spark: SparkSession, path, name_regex: str, keys: Sequence[str],
                     skip: int, names: Sequence[str], key_filter=None,
                     name_col: str | None = None) -> DataFrame:
    """S5 (+U1): read every file under ``path`` and add key columns parsed from its name.

    ``name_regex`` has one group per key (integers).  ``key_filter`` is an optional
    Column predicate on the keys (e.g. weeks 1–4 only, as the reference's merge reads);
    it is applied before parsing, so skipped files' lines are never split.
    """
    df = read_with_preamble(spark, path, skip, names, name_col=name_col)
    kc = {k: F.regexp_extract("file", name_regex, i + 1).try_cast("int") for i, k in enumerate(keys)}
    df = df.withColumns(kc)
    if key_filter is not None:
        df = df.where(key_filter)
    return df.select(*keys, *names, "file", "line_no")


def read_whitespace_text(spark: SparkSession, path) -> DataFrame:
    """Lines of whitespace-separated text → (file, line, fields); blank lines dropped.

    Python's ``strip()``/``split()`` treat U+3000 and other Unicode spaces as blanks;
    the split here uses the same character set as Python for the same reason (Q12).
    """
    df = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"),
                                      F.col("value").alias("line"))
    df = df.where(F.length(ustrip("line")) > 0)
    return df.select("file", "line", whitespace_fields("line").alias("fields"))


def field_count_check(df: DataFrame, key: str = "file", fields: str = "fields") -> DataFrame:
    """Per file, the distinct field counts and whether they disagree."""
    return (df.groupBy(key).agg(F.count(F.lit(1)).alias("n_lines"),
                                F.count_distinct(F.size(fields)).alias("n_widths"),
                                F.min(F.size(fields)).alias("min_fields"),
                                F.max(F.size(fields)).alias("max_fields"))
            .withColumn("inconsistent", F.col("n_widths") > 1))


def extract_urls(spark: SparkSession, path, column_index: int, encoding: str = "Shift_JIS",
                 key_index: int | None = None) -> DataFrame:
    """URLs found in column ``column_index`` of every row of CSV files.

    Lines are decoded in Python (Spark's own ``decode`` takes Shift_JIS only under a session
    switch, and the session is the caller's); bad bytes become U+FFFD; rows too short to have the
    column are skipped; every match of the URL pattern is kept, in order.
    """
    lines = records_of(spark, path, encoding=encoding).select("path", F.col("pos").alias("row_no"), "line")
    lines = lines.where(F.length("line") > 0)
    width = max(column_index, key_index if key_index is not None else 0) + 1
    parsed = _cells(F.col("line"), width)
    key = [parsed.getField(f"c{key_index}").alias("key")] if key_index is not None else []
    cell = lines.select("path", "row_no", *key, parsed.getField(f"c{column_index}").alias("cell"))
    keep = ["path", "row_no"] + (["key"] if key else [])
    return cell.where(F.col("cell").isNotNull()).select(
        *keep, F.posexplode(find_urls("cell")).alias("url_no", "url"))
