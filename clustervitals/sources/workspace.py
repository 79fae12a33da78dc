"""Where intermediate and demonstration files go."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, or a local one when none is configured (local mode only)."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    local = tempfile.mkdtemp(prefix="run-")
    spark.sparkContext.setCheckpointDir(local)
    return local


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def passing(df: DataFrame) -> DataFrame:
    """The same rows, for one action: its shuffle files go when it ends.

    Else they stay until the driver happens to collect its garbage, which at size can be after all the work.
    """
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        return df.select("*")  # a data frame takes the setting when it is made
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)


def keep(df: DataFrame) -> DataFrame:
    """Compute a result once and read it back from the shared folder from then on.

    Later uses neither repeat the work nor depend on the executors that did it, and its shuffle files are gone.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return passing(df).checkpoint()


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def location_resolver() -> Callable:
    """A function from a path or URI to (file system, path on it), for use inside tasks.

    It is made here and captured by the task's own function, so tasks need no
    import of this package.
    """

    def resolve(location: str):
        from pyarrow import fs

        plain = location.removeprefix("file://").removeprefix("file:")
        if "://" not in plain:  # a local path may hold blanks, which no URI does
            return fs.LocalFileSystem(), plain
        return fs.FileSystem.from_uri(plain.replace("s3a://", "s3://", 1))

    return resolve
