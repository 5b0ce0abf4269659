"""Cutting lineage with tables written to the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[SparkSession, str]] = []
_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; only where it is unset and all tasks run in the driver's own process
    (tests), a folder of our own. On a cluster such a folder would be one per machine, so that raises."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors share (master {master})")
        app = spark.sparkContext.applicationId
        folder = _LOCAL.setdefault(app, "") or tempfile.mkdtemp(prefix="tallyforge-")
        _LOCAL[app] = folder
    return folder.rstrip("/")


def written(frame: DataFrame, name: str) -> DataFrame:
    """`frame` as a Parquet table in the shared folder: lost executors recompute nothing before it."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/tallyforge/{uuid.uuid4().hex}-{name}"
    frame.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append((spark, path))
    back = spark.read.schema(frame.schema).parquet(path)
    back._tallyforge_path = path  # type: ignore[attr-defined]
    return back


def release(frame: DataFrame) -> None:
    """Delete a table of `written` that no later step reads."""
    path = getattr(frame, "_tallyforge_path", None)
    if path:
        _remove(frame.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in _WRITTEN:
        if spark.sparkContext._jsc is not None:
            _remove(spark, path)
