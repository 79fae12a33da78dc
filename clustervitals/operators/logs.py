"""Crashes and errors in server logs.

``lines`` has one column ``log_msg`` with raw text ``host:file.csv:<csv record>``.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, time
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import logline
from ..functions.clock import instant
from ..sources.workspace import keep
from .spread import last_n_per_key, lookup_join, running_total


def crash_lines(lines: DataFrame) -> DataFrame:
    """The lines of panics and terminations, found in one scan and kept.

    Several reports start from them; read them from here instead of scanning
    all logs for each.
    """
    line = F.col("log_msg")
    return keep(lines.filter(logline.is_panic(line) | logline.is_terminated(line)))


def panic_events(lines: DataFrame) -> DataFrame:
    line = F.col("log_msg")
    return lines.filter(logline.is_panic(line)).select(
        logline.hostname(line).alias("hostname"),
        logline.log_file(line).alias("logfilename"),
        logline.log_time(line).alias("logtime"),
        logline.process_id(line).alias("pid"),
        logline.session_id(line).alias("sess_id"),
        logline.message(line).alias("logmsg"),
    )


def terminated_events(lines: DataFrame) -> DataFrame:
    line = F.col("log_msg")
    return lines.filter(logline.is_terminated(line)).select(
        logline.hostname(line).alias("hostname"),
        logline.log_file(line).alias("logfilename"),
        logline.log_time(line).alias("logtime"),
        logline.terminated_pid(line).alias("pid"),
        logline.message(line).alias("logmsg"),
    )


_PROCESS = ["hostname", "logfilename", "pid"]

# Below, keys parsed from lines are made non-null: for a nullable key the join
# adds a not-null filter, which would parse every line once more.


def terminated_without_panic(terminated: DataFrame, panics: DataFrame) -> DataFrame:
    """Terminations whose process logged no PANIC in the same file."""
    return lookup_join(terminated, panics.select(*_PROCESS).distinct(), _PROCESS, "left_anti")


def session_log_tail(lines: DataFrame, sessions: DataFrame | None = None, n: int = 100) -> DataFrame:
    """The last n lines of every panicked session, newest first.

    ``sessions`` (sess_id) defaults to the sessions with a PANIC in ``lines``.
    """
    line = F.col("log_msg")
    if sessions is None:
        sessions = panic_events(lines)
    named = sessions.select("sess_id").filter(F.col("sess_id") != "").distinct()
    keyed = lines.select(F.coalesce(logline.session_id(line), F.lit("")).alias("sess_id"), line)
    chosen = lookup_join(keyed, named, ["sess_id"], "left_semi").select("sess_id", logline.log_ts(line).alias("ts"), line)
    return last_n_per_key(chosen, ["sess_id"], [F.desc_nulls_last("ts"), F.desc("log_msg")], n, "line_no")


def process_log_tail(lines: DataFrame, terminations: DataFrame, n: int = 50) -> DataFrame:
    """For every termination, the last n lines of that process in that file up to its time.

    ``terminations``: hostname, logfilename, logtime, pid.  Lines of a process
    get positions in time order; a termination at position p needs positions
    p-n .. p-1, which lie in at most two blocks of n.  Joining on the block
    keeps the work proportional to the output, where a join on the process
    alone would form every (termination, earlier line) pair.
    """
    line = F.col("log_msg")
    # Read twice below, and often the result of a scan of the logs itself.
    wanted = keep(
        terminations.select(*_PROCESS, "logtime")
        .withColumn("ts", logline.time_of(F.col("logtime")))
        .dropna(subset=[*_PROCESS, "ts"])
        .distinct()
    )
    keyed = lines.select(
        F.coalesce(logline.hostname(line), F.lit("")).alias("hostname"),
        F.coalesce(logline.log_file(line), F.lit("")).alias("logfilename"),
        F.coalesce(logline.process_id(line), F.lit(-1)).alias("pid"),
        line,
    )
    # Times are parsed for lines of the wanted processes only.  Equal lines at
    # one instant are kept as one row with a count.
    relevant = (
        lookup_join(keyed, wanted.select(*_PROCESS).distinct(), _PROCESS, "left_semi")
        .withColumn("ts", logline.log_ts(line))
        .dropna(subset=["ts"])
        .groupBy(*_PROCESS, "ts", "log_msg")
        .agg(F.count("*").alias("copies"))
    )
    marks = wanted.withColumn("copies", F.lit(0).cast("long"))
    # At one instant lines sort before marks, so a mark counts the lines of its own instant.
    # Lines of one instant go by digest: range partitioning samples its keys, and texts may be long.
    stacked = (
        relevant.withColumn("is_mark", F.lit(0))
        .withColumn("digest", F.md5("log_msg"))
        .unionByName(marks.withColumn("is_mark", F.lit(1)), allowMissingColumns=True)
    )
    placed = running_total(stacked, _PROCESS, ["ts", "is_mark", "digest", "logtime"], "copies", "end")

    # Only the last n copies of a line can be within n of any later mark.
    copies_from = F.greatest(F.col("end") - F.col("copies"), F.col("end") - n)
    line_rows = placed.filter(F.col("is_mark") == 0).select(
        *_PROCESS,
        "log_msg",
        copies_from.alias("line_from"),
        F.col("end").alias("line_to"),
        F.explode(F.sequence(F.floor(copies_from / n), F.floor((F.col("end") - 1) / n))).alias("block"),
    )
    mark_from = F.greatest(F.col("end") - n, F.lit(0))
    mark_rows = placed.filter((F.col("is_mark") == 1) & (F.col("end") > 0)).select(
        *_PROCESS,
        "logtime",
        mark_from.alias("mark_from"),
        F.col("end").alias("mark_to"),
        F.explode(F.sequence(F.floor(mark_from / n), F.floor((F.col("end") - 1) / n))).alias("block"),
    )
    low = F.greatest("line_from", "mark_from")
    overlap = F.least("line_to", "mark_to") - low
    # A pair sharing two blocks is kept in the first of them.
    first_shared = F.greatest(F.floor(F.col("line_from") / n), F.floor(F.col("mark_from") / n))
    return (
        mark_rows.join(line_rows, [*_PROCESS, "block"])
        .filter((overlap > 0) & (F.col("block") == first_shared))
        .withColumn("position", F.explode(F.sequence(low, low + overlap - 1)))
        .select(
            *_PROCESS, "logtime", (F.col("mark_to") - F.col("position")).cast("int").alias("line_no"), "log_msg"
        )
    )


# The error classes counted in logs.
PATTERNS = {
    "master_panic": logline.PANIC_MARK,
    "segment_panic": logline.PANIC_MARK,
    "internal_error": logline.INTERNAL_ERROR_MARK,
    "out_of_memory": logline.OUT_OF_MEMORY_MARK,
}


def pattern_match(line: Column, host: Column, name: str, coordinators: Sequence[str]) -> Column:
    found = line.contains(PATTERNS[name])
    if name.endswith("_panic"):
        on_coordinator = host.isin(*coordinators) if coordinators else F.lit(False)
        return found & (on_coordinator if name.startswith("master") else ~on_coordinator)
    return found


def last_checks(history: DataFrame, names: dict[str, str], as_of: datetime) -> dict[str, datetime]:
    """When each log check last ran; the start of the ``as_of`` day for one that never did.

    ``names`` gives the metric of each pattern; one row per metric is read.
    """
    listed = history.filter(F.col("metric_name").isin(list(names.values())) & (F.col("ctime") < instant(as_of)))
    found = dict(listed.groupBy("metric_name").agg(F.max("ctime")).collect())
    start = datetime.combine(as_of.date(), time())
    return {pattern: found.get(metric, start) for pattern, metric in names.items()}


def pattern_counts_by_host(
    lines: DataFrame,
    since: datetime | dict[str, datetime],
    coordinators: Sequence[str] = (),
    patterns: Sequence[str] = tuple(PATTERNS),
) -> DataFrame:
    """Matches since the last check per host and error class; every pattern from one scan.

    ``since`` is one time, or one for each pattern.
    """
    line, ts = F.col("log_msg"), logline.log_ts(F.col("log_msg"))
    starts = {name: since[name] if isinstance(since, dict) else since for name in patterns}
    host = logline.hostname(line)
    any_pattern = reduce(or_, [line.contains(text) for text in dict.fromkeys(PATTERNS[p] for p in patterns)])
    counts = (
        lines.filter(any_pattern)
        .filter(ts >= instant(min(starts.values())))
        .groupBy(host.alias("hostname"))
        .agg(
            *[
                F.count_if(pattern_match(line, host, name, coordinators) & (ts >= instant(starts[name]))).alias(name)
                for name in patterns
            ]
        )
    )
    return counts.unpivot("hostname", list(patterns), "pattern", "matches").filter(F.col("matches") > 0)


def pattern_counts(
    lines: DataFrame,
    since: datetime | dict[str, datetime],
    coordinators: Sequence[str] = (),
    patterns: Sequence[str] = tuple(PATTERNS),
) -> DataFrame:
    """Matches since the last check per error class, a 0/1 flag and the hosts concerned.

    Hosts are merged after one row per host is left, so the list is as long as
    the cluster has hosts.
    """
    by_host = pattern_counts_by_host(lines, since, coordinators, patterns)
    found = by_host.groupBy("pattern").agg(
        F.sum("matches").alias("matches"), F.array_sort(F.collect_list("hostname")).alias("hosts")
    )
    every = lines.sparkSession.range(1).select(F.explode(F.array(*[F.lit(p) for p in patterns])).alias("pattern"))
    return (
        every.join(found, "pattern", "left")
        .select(
            "pattern",
            F.coalesce("matches", F.lit(0)).alias("matches"),
            F.when(F.col("matches") > 0, 1).otherwise(0).alias("result"),
            F.coalesce(F.array_join("hosts", ","), F.lit("")).alias("hosts"),
        )
    )
