"""Monitoring history and settings."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import before, instant

# States of a check.
NOT_STARTED, RUNNING, COMPLETED, FAILED = 0, 1, 2, 3

RETENTION_DAYS = 180


def latest_metrics(history: DataFrame) -> DataFrame:
    """Last result per metric; equal times are settled by result.

    The last times are found by hashing; only rows of those times are sorted.
    """
    last = history.groupBy("metric_name").agg(F.max("ctime").alias("last")).withColumnRenamed("metric_name", "name")
    same = F.col("metric_name").eqNullSafe(F.col("name")) & F.col("ctime").eqNullSafe(F.col("last"))
    order = Window.partitionBy("metric_name").orderBy(F.desc("monitor_result"), F.desc("status"))
    ranked = history.join(last, same).withColumn("_place", F.row_number().over(order))
    return ranked.filter("_place = 1").select("metric_name", "ctime", "monitor_result", "status")


def _interval_passed(as_of: datetime) -> Column:
    elapsed = F.timestamp_diff("MICROSECOND", "last_finishtime", instant(as_of))
    return elapsed > F.col("check_interval").cast("long") * 60_000_000


def _due(as_of: datetime) -> Column:
    status = F.col("status")
    return (
        F.when(status == NOT_STARTED, F.lit(True))
        .when(status.isin(COMPLETED, FAILED), F.col("last_finishtime").isNull() | _interval_passed(as_of))
        .otherwise(F.lit(False))
    )


def due_metrics(setup: DataFrame, as_of: datetime) -> DataFrame:
    """Whether each check should run now.

    A running check is not due, one never started is; a finished or failed one
    is due when its interval has passed.  Any other status is an error.
    ``stuck`` marks a check that has been running longer than its interval.
    """
    status = F.col("status")
    return setup.select(
        "monitor_id",
        "metric_name",
        _due(as_of).alias("due"),
        F.when(~status.isin(NOT_STARTED, RUNNING, COMPLETED, FAILED), "invalid status").alias("error"),
        ((status == RUNNING) & F.coalesce(_interval_passed(as_of), F.lit(False))).alias("stuck"),
    )


def reset_checks(setup: DataFrame) -> DataFrame:
    """The settings after a restart: nothing is running and nothing has finished."""
    finish = setup.schema["last_finishtime"].dataType
    return setup.withColumn("status", F.lit(NOT_STARTED)).withColumn("last_finishtime", F.lit(None).cast(finish))


def start_checks(setup: DataFrame, as_of: datetime) -> DataFrame:
    """The settings once every due check has been marked as running."""
    finish = setup.schema["last_finishtime"].dataType
    return setup.withColumns(
        {
            "status": F.when(_due(as_of), F.lit(RUNNING)).otherwise(F.col("status")),
            "last_finishtime": F.when(_due(as_of), instant(as_of).cast(finish)).otherwise(F.col("last_finishtime")),
        }
    )


def record_results(setup: DataFrame, results: DataFrame, as_of: datetime) -> DataFrame:
    """The settings after results came in: status and finish time of the checks that ran.

    ``results``: metric_name, status, one row per check.  Write the outcome to
    a new snapshot; it reads the old one.
    """
    finish = setup.schema["last_finishtime"].dataType
    ran = results.select("metric_name", F.col("status").alias("new_status"))
    joined = setup.join(ran, "metric_name", "left")
    done = F.col("new_status").isNotNull()
    return (
        joined.withColumn("status", F.coalesce("new_status", "status"))
        .withColumn("last_finishtime", F.when(done, instant(as_of).cast(finish)).otherwise(F.col("last_finishtime")))
        .select(*setup.columns)
    )


def apply_retention(history: DataFrame, as_of: datetime, days: int = RETENTION_DAYS) -> DataFrame:
    """History of the last ``days`` days; prunes date partitions when there are any."""
    kept = F.col("ctime") >= before(as_of, timedelta(days=days))
    if "dt" in history.columns:
        kept = kept & (F.col("dt") >= F.lit((as_of - timedelta(days=days)).date()))
    return history.filter(kept)


def evaluate_alerts(latest: DataFrame, setup: DataFrame) -> DataFrame:
    """Metrics at or above their warning value.

    Only checks with warnings on and numeric values on both sides can alert.
    """
    result = F.col("monitor_result").try_cast("double")
    limit = F.col("warning_value").try_cast("double")
    watched = setup.filter(F.col("if_warning")).select("metric_name", "warning_value")
    return latest.join(watched, "metric_name").select(
        "metric_name", "monitor_result", "warning_value", F.coalesce(result >= limit, F.lit(False)).alias("alert")
    )
