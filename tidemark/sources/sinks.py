"""Sinks.

K1 header CSV, K2 one file set per key (``partitionBy``), K3 chosen delimiter, K4 the
sectioned study report as a long table (``tidemark.plans.studies``), K5 preview.
Writers never collect: each task writes its own partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _flatten_arrays(df: DataFrame) -> DataFrame:
    """CSV cannot hold arrays: an array column becomes its elements joined by the delimiter."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.ArrayType):
            out.append(F.array_join(F.col(f.name).cast("array<string>"), "\u0001").alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str, sep: str = ",", header: bool = True,
              mode: str = "overwrite", partition_by: Sequence[str] = ()) -> str:
    """K1/K2/K3: header CSV without index (quotes in values are doubled); ``partition_by`` gives one folder per key."""
    w = df.write.mode(mode).option("header", header).option("sep", sep).option("escape", '"')
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)
    return path


def write_delimited_fields(df: DataFrame, path: str, fields: str, sep: str,
                           mode: str = "overwrite") -> str:
    """K3: rows given as an array of fields (whose counts may differ) → delimited lines."""
    df.select(F.array_join(F.col(fields), sep).alias("value")).write.mode(mode).text(path)
    return path


def write_with_preamble(lines: DataFrame, path: str, name_col: str, pos_col: str,
                        line_col: str = "line", mode: str = "overwrite",
                        preamble_until: int | None = None,
                        max_rows_per_file: int | None = None) -> str:
    """Text files whose exact line order matters (preamble, header, rows).

    ``lines`` holds (name, pos, line); each name becomes the folder ``name=<value>``
    and its lines are written in ``pos`` order.  Without ``max_rows_per_file`` one
    task writes each name's single file.  With it (and ``preamble_until``: lines with
    ``pos`` below it are the preamble), a name with many rows is split into
    ceil(rows / max_rows_per_file) files under ``chunk=<i>`` sub-folders: rows are
    spread by a hash of their position, and every chunk repeats the preamble, so a
    hot name is written by many tasks and every file reads like the original.
    """
    if max_rows_per_file is None or preamble_until is None:
        (lines.repartition(name_col).sortWithinPartitions(name_col, pos_col)
         .select(F.col(line_col).alias("value"), name_col)
         .write.mode(mode).partitionBy(name_col).text(path))
        return path
    is_pre = F.col(pos_col) < F.lit(preamble_until)
    chunks = (lines.where(~is_pre).groupBy(name_col)
              .agg(F.count(F.lit(1)).alias("_rows"))
              .select(name_col, F.greatest(F.lit(1), F.ceil(F.col("_rows") / F.lit(max_rows_per_file)))
                      .cast("int").alias("_chunks")))
    x = lines.join(chunks, name_col, "left").withColumn("_chunks", F.coalesce("_chunks", F.lit(1)))
    pre = x.where(is_pre).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
    rows = x.where(~is_pre).withColumn("chunk", F.pmod(F.xxhash64(F.col(pos_col)), F.col("_chunks")).cast("int"))
    allx = pre.unionByName(rows).drop("_chunks")
    (allx.repartition(name_col, "chunk").sortWithinPartitions(name_col, "chunk", pos_col)
     .select(F.col(line_col).alias("value"), name_col, "chunk")
     .write.mode(mode).partitionBy(name_col, "chunk").text(path))
    return path


def preview(df: DataFrame, n: int = 5, order: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows in an explicit order."""
    return (df.orderBy(*order) if order else df).limit(n)
