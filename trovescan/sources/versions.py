"""Loading several tables as one version.

Plain Parquet has no transaction over several tables. A load writes all of them
into a folder of its own and then adds one small file to the log that says so;
readers follow the log. A load that fails leaves no entry, so nobody sees it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

_LOG = "version bigint, folder string"


def current_version(spark: SparkSession, root: str) -> tuple[int, str | None]:
    """Number and folder of the newest complete version; (0, None) before the first."""
    try:
        log = spark.read.schema(_LOG).parquet(f"{root}/log")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0, None
    row = log.orderBy(F.desc("version")).first()
    return (row["version"], row["folder"]) if row else (0, None)


def load_version(spark: SparkSession, root: str, tables: dict[str, DataFrame]) -> int:
    """Write ``tables`` as the next version of ``root``; visible only when all are there.

    One load at a time: two at once would take the same number.
    """
    version = current_version(spark, root)[0] + 1
    folder = f"{root}/version-{version:06d}-{uuid.uuid4().hex[:8]}"
    for name, table in tables.items():
        table.write.parquet(f"{folder}/{name}")
    entry = spark.createDataFrame([(version, folder)], _LOG).coalesce(1)
    entry.write.mode("append").parquet(f"{root}/log")
    return version


def read_version(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the current version."""
    _, folder = current_version(spark, root)
    if folder is None:
        raise ValueError(f"nothing loaded at {root}")
    return spark.read.parquet(f"{folder}/{name}")
