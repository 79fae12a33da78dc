"""Session counters per snapshot window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clock import seconds_between
from ..operators.sessions import is_active, is_idle_in_transaction, is_waiting


def session_alerts(activity: DataFrame, window: str = "5 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Active, waiting, all and idle-in-transaction sessions per window, and the longest running statement.

    ``activity`` carries ``snapshot_ts``; statement age is measured at the snapshot.
    """
    age = F.when(is_active(), seconds_between(F.col("query_start"), F.col("snapshot_ts")))
    return (
        activity.withColumn("snapshot_ts", F.col("snapshot_ts").cast("timestamp"))
        .withWatermark("snapshot_ts", lateness)
        .groupBy(F.window("snapshot_ts", window).alias("w"))
        .agg(
            F.count_if(is_active()).alias("active_sql"),
            F.count_if(is_waiting()).alias("waiting_sql"),
            F.count("*").alias("connections"),
            F.count_if(is_idle_in_transaction()).alias("idle_in_transaction"),
            F.coalesce(F.rint(F.max(age) / 60).cast("long"), F.lit(0)).alias("longest_sql_minutes"),
        )
        .select(
            F.col("w.start").alias("window_start"),
            "active_sql", "waiting_sql", "connections", "idle_in_transaction", "longest_sql_minutes",
        )
    )
