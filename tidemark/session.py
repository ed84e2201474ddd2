"""Session construction and lineage helpers.

Everything in the library takes an existing ``SparkSession``; this module only
offers a sensible local builder for tests and the bench, and the two
materialisation helpers the studies use.
"""

from __future__ import annotations

import os
import re
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "tidemark") -> SparkSession:
    """A local session configured the way the tests and the bench expect.

    AQE stays on (runtime broadcast conversion, partition coalescing, skew-join
    splitting); the session time zone is pinned to UTC so date casts of
    timestamps agree with DuckDB; ANSI mode is left at Spark's default (on), so
    the library uses ``try_*`` casts wherever the reference was lenient.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Shift_JIS input (URL lists) needs the legacy charset switch in Spark 4.
        .config("spark.sql.legacy.javaCharsets", "true")
        .config("spark.driver.memory", os.environ.get("TIDEMARK_DRIVER_MEMORY", "8g"))
        # remove reliable-checkpoint files once their DataFrames are garbage collected
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's checkpoint folder, setting a scratch one only if unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as is.
    Only when nothing is configured and the master is local (tests) do we pick a fresh
    temporary folder; on a cluster every executor would write its own disk there, so
    that raises.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="tidemark-ckpt-")
    sc.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (never a local one).

    Used where a derived table is re-read many times by later aggregations (the
    study panels); a lost executor then re-reads the checkpoint instead of
    recomputing joins and windows.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder under the shared checkpoint folder for files a job writes and re-reads."""
    import uuid
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tidemark-io/{label}-{uuid.uuid4().hex[:12]}"


#: Plan nodes that make recomputing a frame dear: shuffles, generators and Python stages.
_DERIVED = ("Join", "Aggregate", "Window", "Repartition", "Rebalance", "Generate", "Sort", "Expand",
            "Python", "Pandas", "Arrow", "Groups", "Distinct", "Except", "Intersect")


def _plan_nodes(plan):
    yield plan.getClass().getSimpleName()
    children = plan.children()
    for i in range(children.size()):
        yield from _plan_nodes(children.apply(i))


def materialize_if_derived(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` when recomputing it would redo shuffles (joins, aggregations,
    windows), generators or Python stages; return it as is when it is a plain scan with
    projections and filters.

    For operators that read their input several times (exact quantile selection).
    """
    nodes = _plan_nodes(df._jdf.queryExecution().optimizedPlan())
    if any(op in node for node in nodes for op in _DERIVED):
        return cut_lineage(df)
    return df


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give Python workers this package, wherever the driver was started from.

    Functions of the package travel to workers by name, so a worker must be able to
    import it; a zip of its sources goes along once for each application.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    top = os.path.basename(here)
    path = os.path.join(tempfile.mkdtemp(prefix=f"{top}-zip-"), f"{top}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(here):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join(top, os.path.relpath(full, here)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)
