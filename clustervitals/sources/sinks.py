"""Report tables, metric history and metric text files."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from datetime import datetime, timedelta
from urllib.parse import quote

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.clock import instant
from ..operators.monitor import RETENTION_DAYS, latest_metrics
from .workspace import keep, location_resolver


def save_report(df: DataFrame, path: str) -> None:
    """Replace a report table."""
    df.write.mode("overwrite").parquet(path)


def append_history(df: DataFrame, path: str, mode: str = "append") -> None:
    """Append metric results, partitioned by day.

    The rebalance hint writes few files per day and still splits a day that
    holds most of the rows.
    """
    dated = df.withColumn("dt", F.to_date("ctime"))
    dated.hint("rebalance", "dt").write.mode(mode).partitionBy("dt").parquet(path)


def drop_expired(spark: SparkSession, path: str, as_of: datetime, days: int = RETENTION_DAYS) -> None:
    """Remove rows older than ``days`` days from a history written by ``append_history``.

    Earlier days go as whole folders, without reading them; the day of the limit
    is written again with the rows that stay.
    """
    limit = as_of - timedelta(days=days)
    day = str(limit.date())
    last = keep(spark.read.parquet(path).filter((F.col("dt") == F.lit(limit.date())) & (F.col("ctime") >= instant(limit))))
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    expired = day if last.isEmpty() else str(limit.date() - timedelta(days=1))
    for folder in system.listStatus(root):
        name = folder.getPath().getName()
        if name.startswith("dt=") and name.removeprefix("dt=") <= expired:
            system.delete(folder.getPath(), True)
    if expired != day:
        last.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt").parquet(path)


def export_metric_text(history: DataFrame, out_dir: str) -> None:
    """Write the latest value of each metric to ``<out_dir>/<metric>.txt``.

    A check that failed without a result leaves the earlier value in place.
    After aggregation each task writes its metrics' files: to a temporary name
    first, then renamed, so a reader never sees half a file and a repeated task
    does no harm.
    """
    resolve = location_resolver()

    def write(rows: Iterator[Row]) -> None:
        system, root = resolve(out_dir)
        system.create_dir(root, recursive=True)
        for row in rows:
            target = f"{root}/{quote(row.metric_name, safe='')}.txt"
            partial = f"{target}.{uuid.uuid4().hex}.tmp"
            with system.open_output_stream(partial) as out:
                out.write(row.monitor_result.encode())
            system.move(partial, target)

    measured = history.filter(F.col("monitor_result") != "")
    latest_metrics(measured).select("metric_name", "monitor_result").foreachPartition(write)


def read_metric_text(spark: SparkSession, out_dir: str) -> DataFrame:
    """Exported metric values."""
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.txt$", 1)
    return spark.read.option("pathGlobFilter", "*.txt").text(out_dir, wholetext=True).select(
        F.url_decode(F.url_decode(name)).alias("metric_name"), F.col("value").alias("monitor_result")
    )

