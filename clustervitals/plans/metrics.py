"""All monitoring checks as rows for the metric history."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import instant
from ..operators import age, cluster, locks, logs, sessions, skew
from ..operators.monitor import COMPLETED

# Metric names of session counters, resource counters and log classes.
SESSION_METRICS = {
    "active_sql": "gpdb_total_sql",
    "waiting_sql": "gpdb_total_waiting_sql",
    "connections": "gpdb_total_connections",
    "idle_in_transaction": "gpdb_total_idle_in_transaction",
    "longest_sql_minutes": "gpdb_long_sql_running_time",
}
GROUP_METRICS = {"running": "gpdb_resource_group_running_sql", "queueing": "gpdb_resource_group_waiting_sql"}
QUEUE_METRICS = {"running": "gpdb_resource_queue_running_sql", "waiting": "gpdb_resource_queue_waiting_sql"}
LOG_METRICS = {
    "master_panic": "gpdb_check_master_panic",
    "segment_panic": "gpdb_check_segment_panic",
    "internal_error": "gpdb_check_internal_error",
    "out_of_memory": "gpdb_check_oom",
}


def renamed(name: str, metrics: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in metrics.items() for x in pair])[F.col(name)]


def _one(df: DataFrame, metric: str, value: str) -> DataFrame:
    """A single figure; 0 when there is nothing to measure."""
    return df.agg(F.coalesce(F.max(value).cast("string"), F.lit("0")).alias("v")).select(
        F.lit(metric).alias("metric_name"), F.col("v").alias("monitor_result")
    )


def _several(df: DataFrame, metrics: dict[str, str]) -> DataFrame:
    long = df.unpivot([], list(metrics), "k", "v")
    return long.select(renamed("k", metrics).alias("metric_name"), F.col("v").cast("string").alias("monitor_result"))


def _checks(inputs: dict[str, DataFrame], as_of: datetime, since: datetime | dict[str, datetime], coordinators) -> Iterator[DataFrame]:
    if "conf" in inputs:
        conf = inputs["conf"]
        yield _one(cluster.segments_down(conf), "gpdb_segment_down", "result")
        yield _one(cluster.segments_out_of_sync(conf), "gpdb_primary_mirror_sync_state", "result")
        yield _one(cluster.role_switched(conf), "gpdb_segment_role_switch", "result")
    if "workfiles" in inputs:
        yield _one(sessions.top_workfile(inputs["workfiles"]), "gpdb_workfile_usage_per_query", "workfile_gb")
    if "locks" in inputs:
        yield _one(locks.longest_lock_wait(inputs["locks"], as_of), "gpdb_check_lock_tables", "wait_minutes")
    if "activity" in inputs:
        counters = sessions.session_metrics(inputs["activity"], as_of)
        yield counters.select(
            renamed("metric_name", SESSION_METRICS).alias("metric_name"), F.col("result").cast("string").alias("monitor_result")
        )
    if "resource_groups" in inputs:
        yield _several(sessions.resource_group_totals(inputs["resource_groups"]), GROUP_METRICS)
    if "resource_queues" in inputs:
        yield _several(sessions.resource_queue_counts(inputs["resource_queues"]), QUEUE_METRICS)
    if "processes" in inputs:
        yield _one(skew.session_process_skew(inputs["processes"], 1), "gpdb_check_session_processes", "sess_proc_count")
    if "lines" in inputs:
        found = logs.pattern_counts(inputs["lines"], since, coordinators)
        yield found.select(
            renamed("pattern", LOG_METRICS).alias("metric_name"), F.col("matches").cast("string").alias("monitor_result")
        )
    if "dbs" in inputs:
        yield _one(age.database_age(inputs["dbs"], 1), "gpdb_check_master_age", "age_int")
        yield _one(age.segment_age(inputs["dbs"], 1), "gpdb_check_segment_age", "age_int")


def metric_results(
    inputs: dict[str, DataFrame],
    as_of: datetime,
    since: datetime | None = None,
    coordinators: tuple[str, ...] = (),
    history: DataFrame | None = None,
) -> DataFrame:
    """One history row per check: ctime, metric_name, monitor_result, status.

    ``inputs`` may hold conf, workfiles, locks, activity, resource_groups,
    resource_queues, processes, lines and dbs.  Log checks count from ``since``,
    else each from its last row in ``history`` before ``as_of``, else from the
    start of the ``as_of`` day.  Append the result with ``append_history`` and
    export it with ``export_metric_text``.
    """
    start = since or as_of.replace(hour=0, minute=0, second=0, microsecond=0)
    if since is None and history is not None:
        start = logs.last_checks(history, LOG_METRICS, as_of)
    results = reduce(DataFrame.unionByName, _checks(inputs, as_of, start, coordinators))
    return results.select(
        instant(as_of).alias("ctime"), "metric_name", "monitor_result", F.lit(COMPLETED).alias("status")
    )
