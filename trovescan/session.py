"""Session helpers: where intermediate tables go, and how they are cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, named by ``spark.checkpoint.dir``.

    Only a local-mode session (tests) may go without; it gets one temporary
    folder for its lifetime.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    if sc.applicationId not in _local_dirs:
        _local_dirs[sc.applicationId] = tempfile.mkdtemp(prefix="trovescan-")
    return _local_dirs[sc.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nobody has used yet."""
    return f"{shared_dir(spark)}/trovescan/{name}-{uuid.uuid4().hex}"


_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Arrow batches to and from Python take about so many bytes at most; Spark alone counts rows, of any width.
BATCH_BYTES = 8 << 20


def materialize(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, fixes values that depend on task placement, and lets
    several consumers share one computation. A lost executor costs only the
    tasks it was running. With ``release``, what was shuffled for it goes
    from the disks at once, not when the driver next collects its garbage.
    Python steps in ``df`` get batches of ``BATCH_BYTES``, unless the session
    has a limit of its own: ten thousand wide rows would take hundreds of MB.
    """
    spark = df.sparkSession
    path, before = scratch_path(spark, name), spark.conf.get(_RELEASE)
    limit = spark.conf.get(_BATCH, None)
    spark.conf.set(_RELEASE, str(release or before == "true").lower())
    spark.conf.set(_BATCH, limit or str(BATCH_BYTES))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_RELEASE, before)
        spark.conf.unset(_BATCH) if limit is None else spark.conf.set(_BATCH, limit)
    return spark.read.schema(df.schema).parquet(path)
