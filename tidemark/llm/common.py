"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps
from inspect import isgeneratorfunction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package

#: Bytes of output after which a task hands an Arrow batch back to Spark.
FLUSH_BYTES = 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only, found by exact name.

    Works on frames that also hold columns of the same name in another case, or the
    same name twice (the first is taken); all other columns are left out, so no
    column of the input can clash with one that an operator adds.
    """
    at: dict[str, int] = {}
    for i, c in enumerate(df.columns):
        at.setdefault(c, i)
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"c{at[n]}").alias(n) for n in names])


#: What frees the tables that a Python worker keeps from task to task.
_HELD: list[Callable[[], None]] = []


def hold(clear: Callable[[], None]) -> None:
    """Registers what frees a table that outlives its task."""
    _HELD.append(clear)


def free_held() -> None:
    """Frees the tables that tasks of other operators left in this worker."""
    for clear in _HELD:
        clear()
    give_back()


def give_back() -> None:
    """Returns freed memory to the system.  Allocators keep it otherwise, and a worker lives through many stages, idle or
    beside what its executor needs then."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass                                # only glibc has it


def tidy(run: Callable) -> Callable:
    """The function of a task (or of a group), after which the memory that it has freed goes back to the system."""
    @wraps(run)
    def iterator(given):
        try:
            yield from run(given)
        finally:
            give_back()

    @wraps(run)
    def single(given):
        try:
            return run(given)
        finally:
            give_back()

    return iterator if isgeneratorfunction(run) else single


def map_rows(df: DataFrame, make: Callable[[], Callable[[list], Iterator[tuple]]], schema: pa.Schema,
             spark_schema: str, weigh: Callable[[tuple], int] | None = None, keeps: bool = False) -> DataFrame:
    """``mapInArrow`` over rows: ``make()`` runs once per task and returns a function from a
    list of input columns (Python lists) to output tuples.  What the function keeps of other
    rows goes when the task ends, if it has a ``clear``.

    Output is handed back in pieces of about ``FLUSH_BYTES`` (by ``weigh``) or 4096 rows,
    so a task never holds its whole result.  Tables that other tasks left go first, unless this one ``keeps`` them.
    """
    ship_package(df.sparkSession)

    @tidy
    def run(batches):
        if not keeps:
            free_held()
        fn = make()
        rows: list[tuple] = []
        size = 0
        try:
            for b in batches:
                for at in range(0, b.num_rows, 1000):
                    for row in fn([c.to_pylist() for c in b.slice(at, 1000).columns]):
                        rows.append(row)
                        size += weigh(row) if weigh else 64
                        if size >= FLUSH_BYTES or len(rows) >= 4096:
                            yield to_batch(rows, schema)
                            rows, size = [], 0
            if rows:
                yield to_batch(rows, schema)
        finally:
            getattr(fn, "clear", lambda: None)()
    return df.mapInArrow(run, spark_schema)


def map_slices(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]) -> DataFrame:
    """Rows changed or left out, columns as they are: ``make()`` runs once per task and returns a
    function from a record batch to one of the same columns.  Columns are told by place, so their
    names may clash with anything."""
    ship_package(df.sparkSession)
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])

    @tidy
    def run(batches):
        free_held()
        fn = make()
        for b in batches:
            for first in range(0, b.num_rows, 2000):
                yield fn(b.slice(first, 2000))

    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)


def replace(b: pa.RecordBatch, at: int, values: list) -> pa.RecordBatch:
    """The batch with one column's values replaced."""
    cols = list(b.columns)
    cols[at] = pa.array(values, type=cols[at].type)
    return pa.RecordBatch.from_arrays(cols, schema=b.schema)


#: Rows of a side (of a few numbers each) that may be broadcast; a larger one is joined by a shuffle.
SMALL_ROWS = 1 << 20


def small(df: DataFrame) -> DataFrame:
    """Marked for broadcast where a count shows that it is small; otherwise as it is."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, schema)], schema=schema)


def crc_remainder(key: Column, modulus: int) -> Column:
    """crc32 of the key's decimal text, modulo ``modulus`` (null for a null key)."""
    return F.crc32(key.cast("string").cast("binary")) % F.lit(modulus)
