"""Scratch tables in the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder URI under ``spark.checkpoint.dir``.

    Where that setting is unset, a temporary folder is used if the master is
    local (tests), and an error is raised on a cluster: executors couldn't see
    the driver's disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _local:
            _local[app] = tempfile.mkdtemp(prefix="loomscreen-")
            atexit.register(shutil.rmtree, _local[app], ignore_errors=True)
        base = f"file://{_local[app]}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, partitioned_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again, which cuts its lineage."""
    path = shared_dir(df.sparkSession, name)
    writer = df.write
    if partitioned_by:
        writer = writer.partitionBy(*partitioned_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def columns(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the named columns, under the operator's own names (``new=old``)."""
    return df.select(*(df[old].alias(new) for new, old in wanted.items()))
