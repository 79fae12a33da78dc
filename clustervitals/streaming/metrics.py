"""Metric history kept and exported as results arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.monitor import COMPLETED, latest_metrics
from ..operators.sessions import merged_session_counts, session_counts, session_metrics_by_snapshot
from ..plans.metrics import SESSION_METRICS, renamed
from ..sources.sinks import append_history, export_metric_text
from .runs import RunTable
from .sinks import batch_dir, run_batches

_COLUMNS = ["ctime", "metric_name", "monitor_result", "status"]


def _latest(spark: SparkSession, out: str) -> RunTable:
    return RunTable(spark, f"{out}/latest", lambda rows: latest_metrics(rows).select(*_COLUMNS))


def stream_latest_metrics(
    history: DataFrame, out: str, checkpoint: str, text_dir: str | None = None, trigger: dict | None = None
) -> StreamingQuery:
    """Append each batch to the history and keep the latest result per metric.

    ``out/history/batch=<n>/dt=...`` holds the rows.  A batch adds its own latest results to the run table
    ``out/latest``; the latest of all is the latest of these, so nothing earlier is read for it and a repeated batch
    does no harm.  ``read_latest`` gives them.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, rows, written = batch.sparkSession, batch.select(*_COLUMNS), batch_dir(f"{out}/history", batch_id)
        append_history(rows, written, mode="overwrite")
        # From here on the batch is read from what was just written.
        table = _latest(spark, out)
        added = table.add(spark.read.schema(rows.schema).parquet(written).select(*_COLUMNS), batch_id)
        if text_dir:
            named = added.select("metric_name").distinct()
            export_metric_text(table.read().join(named, "metric_name", "left_semi"), text_dir)

    return run_batches(history, write, checkpoint, trigger)


def read_latest(spark: SparkSession, out: str) -> DataFrame:
    """(ctime, metric_name, monitor_result, status): the latest result of each metric; none before the first batch."""
    found = _latest(spark, out).read()
    if found is None:
        return spark.createDataFrame([], "ctime timestamp_ntz, metric_name string, monitor_result string, status int")
    return found


def _counts(spark: SparkSession, out: str) -> RunTable:
    return RunTable(spark, f"{out}/counts", merged_session_counts, order=["snapshot_ts"])


def _results(spark: SparkSession, out: str) -> RunTable:
    """Of each snapshot and metric the result of the last batch that measured it."""

    def last(rows: DataFrame) -> DataFrame:
        value = F.max_by(F.struct("monitor_result", "status"), "batch").alias("value")
        found = rows.groupBy("ctime", "metric_name").agg(value, F.max("batch").alias("batch"))
        return found.select("ctime", "metric_name", "value.monitor_result", "value.status", "batch")

    return RunTable(spark, f"{out}/results", last, order=["ctime"])


def stream_metric_results(
    activity: DataFrame, out: str, checkpoint: str, text_dir: str | None = None, trigger: dict | None = None
) -> StreamingQuery:
    """Session metrics of every snapshot, one row per snapshot and metric.

    ``activity`` carries ``snapshot_ts``.  A batch adds the counts of what it brings to the run table
    ``out/counts``, reads there the counts of the snapshots that it names, and adds their metrics to ``out/results``,
    so a snapshot may be spread over batches or come late.  Runs are sorted by time: other snapshots are skipped by
    their files' statistics.  ``read_results`` gives the rows; the newest snapshot is exported to ``text_dir``.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, table = batch.sparkSession, _counts(batch.sparkSession, out)
        newest = table.state(before=batch_id)[1].get("newest")
        part = session_counts(batch)
        found = part.agg(F.max("snapshot_ts").cast("string")).first()[0]
        newest = max((t for t in (newest, found) if t is not None), default=None)
        named = table.add(part, batch_id, {"newest": newest}).select(F.col("snapshot_ts").alias("named_ts"))
        first, last = named.agg(F.min("named_ts"), F.max("named_ts")).first()
        near = F.col("snapshot_ts").between(F.lit(first), F.lit(last)) | F.col("snapshot_ts").isNull()
        whole = table.read(where=near).join(named, F.col("snapshot_ts").eqNullSafe(F.col("named_ts")), "left_semi")
        results = session_metrics_by_snapshot(whole).select(
            F.col("snapshot_ts").alias("ctime"), renamed("metric_name", SESSION_METRICS).alias("metric_name"),
            F.col("result").cast("string").alias("monitor_result"), F.lit(COMPLETED).alias("status"),
            F.lit(batch_id).cast("long").alias("batch"),
        )
        added = _results(spark, out).add(results, batch_id)
        if text_dir and newest is not None:
            export_metric_text(added.filter(F.col("ctime") == F.lit(newest).cast(added.schema["ctime"].dataType)), text_dir)

    return run_batches(activity, write, checkpoint, trigger)


def read_results(spark: SparkSession, out: str) -> DataFrame:
    """(ctime, metric_name, monitor_result, status): the metrics of each snapshot; none before the first batch."""
    found = _results(spark, out).read()
    if found is None:
        return spark.createDataFrame([], "ctime timestamp_ntz, metric_name string, monitor_result string, status int")
    return found.select(*_COLUMNS)
