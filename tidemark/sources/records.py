"""Records of delimited files whose quoted fields may hold line ends, read by splits.

A record ends at a line end outside double quotes, so whether a line begins a record depends on the
number of quotes in all of the file before it.  No file is read as one piece:

1. Lines are read by splits and stored once with their split (file and first byte) and their order
   in it, so all later steps see the same splits whatever executors come and go.
2. Each split counts its lines and its lines with an odd number of quotes; a running sum over the splits of a
   file (one row each) gives every split the state it opens in and its first line's number.
3. In files without odd lines each line is a record, and its number is the split's plus its place.
4. In the others a running sum inside each split tells which lines begin a record, a second running sum
   over the splits numbers the records, and lines of one number are joined: those of a
   record that crosses a split's edge come from both sides.

Quotes are counted in bytes, which holds for UTF-8 and the encodings where a quote's and a line end's
byte stand for nothing else (Shift_JIS, Latin-1).  A quote that is never closed makes the rest of its file one record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, scratch_path, ship_package

_SPLIT = ["path", "block"]
#: Splits (a row of a few numbers each) that may be broadcast; more are joined by a shuffle.
_FEW_SPLITS = 1 << 18


def has_odd_quotes(line) -> Column:
    """Whether a line holds an odd number of double quotes."""
    c = F.col(line) if isinstance(line, str) else line
    return (F.octet_length(c) - F.octet_length(F.replace(c, F.lit('"'), F.lit("")))) % 2 == 1


def has_quoted_line_ends(spark: SparkSession, path) -> bool:
    """Whether any line under ``path`` opens a quote without closing it (one scan by splits)."""
    return not spark.read.option("lineSep", "\n").text(path).where(has_odd_quotes("value")).isEmpty()


def stored_lines(spark: SparkSession, path, name_col: str | None = None, encoding: str | None = None) -> DataFrame:
    """file, path, block, at, line: every line of every file under ``path``, stored once.

    ``file`` is the logical name (the file's, or a partition folder's value with ``name_col``), ``path`` the physical
    file, ``block`` its split's first byte and ``at`` the order in the split.
    """
    raw = spark.read.option("lineSep", "\n").text(path)
    name = F.col(name_col) if name_col else F.col("_metadata.file_name")
    lines = raw.select(name.cast("string").alias("file"), F.col("_metadata.file_path").alias("path"),
                       F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"),
                       F.col("value").alias("line"))
    if encoding:
        ship_package(spark)

        def decoded(batches):
            for b in batches:
                yield b.assign(line=[bytes(x).decode(encoding, "replace") for x in b["line"]])

        lines = lines.withColumn("line", F.col("line").cast("binary")) \
            .mapInPandas(decoded, "file string, path string, block long, at long, line string")
    out = scratch_path(spark, "lines")
    lines.write.parquet(out)
    return spark.read.schema("file string, path string, block long, at long, line string").parquet(out)


def _before(value: Column) -> Column:
    """The sum of a number over the earlier splits of a file."""
    w = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0))


def records(lines: DataFrame) -> DataFrame:
    """file, path, pos, line: the records of ``stored_lines`` (line ends inside quotes are kept, the ones after
    a record go), numbered from 0 in each file."""
    odd = has_odd_quotes("line").cast("int")
    splits = lines.groupBy("path", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"), F.sum(odd).alias("odd"))
    splits = cut_lineage(splits.select("path", "block", "first", _before(F.col("n")).alias("base"), (_before(F.col("odd")) % 2).alias("opening"),
                                       (F.sum("odd").over(Window.partitionBy("path")) > 0).alias("mixed")))
    shown = F.regexp_replace("line", "\r$", "").alias("line")
    seen = splits.agg(F.count(F.lit(1)).alias("n"), F.max("mixed").alias("mixed")).first()
    few = seen.n <= _FEW_SPLITS
    at_hand = lambda df: F.broadcast(df) if few else df
    placed = lines.join(at_hand(splits), _SPLIT)
    plain = placed.where("not mixed").select("file", "path", (F.col("base") + F.col("at") - F.col("first")).alias("pos"), shown)
    if not seen.mixed:
        return plain

    w = Window.partitionBy(*_SPLIT).orderBy("at")
    inside = (F.col("opening") + F.coalesce(F.sum(odd).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) % 2 == 1
    told = placed.where("mixed").select("file", "path", "block", "at", "line", odd.alias("odd"), (~inside).alias("begins"))
    told = told.withColumn("nth", F.sum(F.col("begins").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = scratch_path(lines.sparkSession, "told")
    told.write.parquet(out)
    told = lines.sparkSession.read.schema(told.schema).parquet(out)
    first = told.groupBy("path", "block").agg(F.max("nth").alias("n")).select("path", "block", _before(F.col("n")).alias("base"))
    told = told.join(at_hand(first), _SPLIT).withColumn("pos", F.col("base") + F.col("nth") - 1)
    alone = F.col("begins") & (F.col("odd") == 0)
    parts = F.array_sort(F.collect_list(F.struct("block", "at", "line")))
    joined = told.where(~alone).groupBy("file", "path", "pos").agg(F.array_join(F.transform(parts, lambda p: p["line"]), "\n").alias("line"))
    whole = told.where(alone).select("file", "path", "pos", "line").union(joined)
    return plain.union(whole.select("file", "path", "pos", shown))


def records_of(spark: SparkSession, path, name_col: str | None = None, encoding: str | None = None) -> DataFrame:
    """The records of every file under ``path``."""
    return records(stored_lines(spark, path, name_col, encoding))
