"""Who runs, waits or idles.

``activity`` has one row per session: pid, sess_id, usename, state, waiting,
query_start, xact_start, state_change, query.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import before, instant, whole_minutes
from ..functions.names import query_snippet

ACTIVE = "active"
IDLE = "idle"
IDLE_IN_TRANSACTION = "idle in transaction"


def is_active() -> Column:
    return F.col("state") == ACTIVE


def is_waiting() -> Column:
    return is_active() & F.col("waiting")


def is_idle_in_transaction() -> Column:
    return F.col("state") == IDLE_IN_TRANSACTION


def active_sql(activity: DataFrame) -> DataFrame:
    return activity.agg(F.count_if(is_active()).alias("active_sql"))


def waiting_sql(activity: DataFrame) -> DataFrame:
    return activity.agg(F.count_if(is_waiting()).alias("waiting_sql"))


def connections(activity: DataFrame) -> DataFrame:
    return activity.agg(F.count("*").alias("connections"))


def idle_in_transaction(activity: DataFrame) -> DataFrame:
    return activity.agg(F.count_if(is_idle_in_transaction()).alias("idle_in_transaction"))


def longest_sql_minutes(activity: DataFrame, as_of: datetime) -> DataFrame:
    """Minutes the oldest active statement has run; 0 when none is active."""
    oldest = F.min(F.when(is_active(), F.col("query_start")))
    return activity.agg(
        F.coalesce(whole_minutes(oldest, instant(as_of)), F.lit(0)).alias("longest_sql_minutes")
    )


def session_metrics(activity: DataFrame, as_of: datetime) -> DataFrame:
    """All session counters from one scan, one row per metric."""
    oldest = F.min(F.when(is_active(), F.col("query_start")))
    wide = activity.agg(
        F.count_if(is_active()).alias("active_sql"),
        F.count_if(is_waiting()).alias("waiting_sql"),
        F.count("*").alias("connections"),
        F.count_if(is_idle_in_transaction()).alias("idle_in_transaction"),
        F.coalesce(whole_minutes(oldest, instant(as_of)), F.lit(0)).alias("longest_sql_minutes"),
    )
    return wide.unpivot([], wide.columns, "metric_name", "result")


def session_counts(activity: DataFrame) -> DataFrame:
    """One row per ``snapshot_ts`` with counts that can be added up and the oldest start of an active statement."""
    return activity.groupBy("snapshot_ts").agg(
        F.count_if(is_active()).alias("active_sql"),
        F.count_if(is_waiting()).alias("waiting_sql"),
        F.count("*").alias("connections"),
        F.count_if(is_idle_in_transaction()).alias("idle_in_transaction"),
        F.min(F.when(is_active(), F.col("query_start"))).alias("oldest_start"),
    )


_ADDED = ["active_sql", "waiting_sql", "connections", "idle_in_transaction"]


def merged_session_counts(parts: DataFrame) -> DataFrame:
    """Parts made by ``session_counts`` as one row per snapshot."""
    return parts.groupBy("snapshot_ts").agg(*(F.sum(c).alias(c) for c in _ADDED), F.min("oldest_start").alias("oldest_start"))


def session_metrics_by_snapshot(counts: DataFrame) -> DataFrame:
    """The figures of ``session_metrics`` for each snapshot, from parts made by ``session_counts``."""
    longest = F.coalesce(whole_minutes(F.col("oldest_start"), F.col("snapshot_ts")), F.lit(0))
    wide = merged_session_counts(counts).select("snapshot_ts", *_ADDED, longest.alias("longest_sql_minutes"))
    return wide.unpivot(["snapshot_ts"], [*_ADDED, "longest_sql_minutes"], "metric_name", "result")


def long_idle_transactions(
    activity: DataFrame, as_of: datetime, limit: timedelta = timedelta(days=1)
) -> DataFrame:
    """Idle transactions begun, or last active, longer ago than ``limit``."""
    cutoff = before(as_of, limit)
    last_change = F.coalesce("state_change", "query_start")
    return activity.filter(
        is_idle_in_transaction() & ((F.col("xact_start") < cutoff) | (last_change < cutoff))
    )


def long_queries(activity: DataFrame, as_of: datetime, limit: timedelta = timedelta(days=1)) -> DataFrame:
    """Active statements older than ``limit``, with the start of their text."""
    return activity.filter(is_active() & (F.col("query_start") < before(as_of, limit))).withColumn(
        "query", query_snippet(F.col("query"))
    )


def idle_session_candidates(
    activity: DataFrame,
    as_of: datetime,
    transaction_limit: timedelta = timedelta(hours=3),
    connection_limit: timedelta = timedelta(hours=12),
    by_state_change: bool = True,
) -> DataFrame:
    """Sessions an administrator may close, with the reason.  A list only.

    ``by_state_change`` measures from the last state change; without it idle
    transactions count from their start and idle sessions from their last
    query (limits of 1 and 24 hours are usual there).
    """
    transaction_since = F.col("state_change" if by_state_change else "xact_start")
    connection_since = F.col("state_change" if by_state_change else "query_start")
    reason = F.when(
        is_idle_in_transaction() & (transaction_since < before(as_of, transaction_limit)), IDLE_IN_TRANSACTION
    ).when((F.col("state") == IDLE) & (connection_since < before(as_of, connection_limit)), IDLE)
    return activity.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def top_workfile(workfiles: DataFrame) -> DataFrame:
    """Largest spill of one query on one segment, in GB; 0.00 when there is none."""
    size_gb = F.round(F.col("top.size_bytes").cast("decimal(20,0)") / (1 << 30), 2).cast("decimal(18,2)")
    top = F.max(F.struct("size_bytes", (-F.col("pid")).alias("neg_pid"), "sess_id", "usename", "segid"))
    return workfiles.agg(top.alias("top")).select(
        (-F.col("top.neg_pid")).alias("pid"),
        "top.sess_id",
        "top.usename",
        "top.segid",
        F.coalesce(size_gb, F.lit(0).cast("decimal(18,2)")).alias("workfile_gb"),
    )


def resource_group_totals(status: DataFrame) -> DataFrame:
    return status.agg(
        F.coalesce(F.sum("num_running"), F.lit(0)).alias("running"),
        F.coalesce(F.sum("num_queueing"), F.lit(0)).alias("queueing"),
    )


def resource_queue_counts(activity: DataFrame) -> DataFrame:
    return activity.agg(
        F.count_if(F.col("resqstatus") == "running").alias("running"),
        F.count_if(F.col("resqstatus") == "waiting").alias("waiting"),
    )


def orphan_temp_schemas(namespaces: DataFrame, activity: DataFrame) -> DataFrame:
    """Temporary schemas, on the coordinator or any segment, whose session is gone."""
    session = F.regexp_extract("nspname", r"^pg_(?:toast_)?temp_([0-9]+)$", 1)
    temporary = (
        namespaces.select("nspname")
        .distinct()
        .withColumn("sess_id", F.nullif(session, F.lit("")).try_cast("long"))
        .filter(F.col("sess_id").isNotNull())
    )
    return temporary.join(activity.select("sess_id").distinct(), "sess_id", "left_anti").select("nspname", "sess_id")
