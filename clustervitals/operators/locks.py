"""Who waits on whose lock.

``locks`` has one row per relation lock joined to its session: relation, pid,
usename, lockmode, granted, xact_start and, where known, waiting and query.
A waiter is blocked by every granted lock on its relation whose transaction
began earlier.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import instant, seconds_between, whole_minutes
from ..functions.names import query_snippet
from .scope import FIRST_USER_OID
from .spread import lookup_join, running_total

SHARE_LOCK = "ShareLock"


def lock_sessions(locks: DataFrame, activity: DataFrame, first_oid: int = FIRST_USER_OID) -> DataFrame:
    """Relation locks of user tables on the coordinator, with their sessions."""
    wanted = locks.filter(
        (F.col("locktype") == "relation") & (F.col("relation") > first_oid) & (F.col("segid") == -1)
    )
    sessions = activity.select("pid", "usename", "state", "waiting", "xact_start", "query")
    return wanted.select("relation", "pid", "lockmode", "granted").join(_short(sessions), "pid")


def _short(locks: DataFrame) -> DataFrame:
    """Statement text cut to its report length, so rows stay small wherever they are sent."""
    return locks.withColumn("query", query_snippet(F.col("query"))) if "query" in locks.columns else locks


def _waiters(locks: DataFrame) -> DataFrame:
    waiting = ~F.col("granted") & (F.col("lockmode") != SHARE_LOCK)
    if "waiting" in locks.columns:
        waiting = waiting & F.col("waiting")
    return _short(locks).filter(waiting & F.col("relation").isNotNull() & F.col("xact_start").isNotNull())


def _holders(locks: DataFrame) -> DataFrame:
    holding = F.col("granted") & (F.col("lockmode") != SHARE_LOCK)
    return _short(locks).filter(holding & F.col("relation").isNotNull() & F.col("xact_start").isNotNull())


def _oldest_holder(locks: DataFrame) -> DataFrame:
    """The earliest transaction holding each relation; ties go to the lowest pid.

    The earliest start is found by hashing; only locks of that start are sorted.
    """
    run = ["xact_start", "pid", "usename", "lockmode", *(c for c in ("state", "query") if c in locks.columns)]
    holders = _holders(locks)
    first = holders.groupBy("relation").agg(F.min("xact_start").alias("xact_start"))
    order = Window.partitionBy("relation").orderBy(*run)
    earliest = holders.join(first, ["relation", "xact_start"]).withColumn("_place", F.row_number().over(order))
    return earliest.filter("_place = 1").select("relation", F.struct(*run).alias("run"))


def lock_waits(locks: DataFrame, as_of: datetime) -> DataFrame:
    """One row per blocked session: how many transactions block it, and the oldest of them.

    The blockers of a waiter are a prefix of the relation's holders in start
    order, so a running count gives their number without forming
    waiter-holder pairs; the work is linear however hot a relation is.
    ``lock_wait_pairs`` spells the pairs out for sessions of interest.
    """
    # At equal start times waiters sort first (kind 0): a blocker is strictly older.
    starts = (
        _holders(locks)
        .groupBy("relation", "xact_start")
        .agg(F.count("*").alias("starts"))
        .withColumn("kind", F.lit(1))
    )
    waiters = _waiters(locks).withColumn("starts", F.lit(0).cast("long")).withColumn("kind", F.lit(0))
    stacked = waiters.unionByName(starts, allowMissingColumns=True)
    counted = running_total(stacked, ["relation"], ["xact_start", "kind", "pid"], "starts", "n_holders")
    blocked = counted.filter((F.col("kind") == 0) & (F.col("n_holders") > 0))
    detail = [F.col("query").alias("wait_sql")] if "query" in locks.columns else []
    run_detail = [
        F.col(f"run.{c}").alias(alias)
        for c, alias in (("query", "run_sql"), ("state", "run_state"))
        if c in locks.columns
    ]
    return lookup_join(blocked, _oldest_holder(locks), ["relation"]).select(
        F.col("relation").alias("lock_table"),
        F.col("lockmode").alias("wait_lockmode"),
        F.col("usename").alias("wait_user"),
        F.col("pid").alias("wait_procpid"),
        F.col("xact_start").alias("wait_start"),
        seconds_between(F.col("xact_start"), instant(as_of)).alias("wait_seconds"),
        *detail,
        "n_holders",
        F.col("run.lockmode").alias("run_lockmode"),
        F.col("run.usename").alias("run_user"),
        F.col("run.pid").alias("run_procpid"),
        F.col("run.xact_start").alias("xact_start"),
        seconds_between(F.col("run.xact_start"), instant(as_of)).alias("xact_seconds"),
        *run_detail,
    )


def lock_wait_pairs(locks: DataFrame, waiters: DataFrame, as_of: datetime) -> DataFrame:
    """Every (waiter, holder) pair of the sessions listed in ``waiters`` (pid).

    The number of pairs of a session is its ``n_holders`` in ``lock_waits``, so
    look there first.  The chosen waiters meet the holders where those are;
    holders are not shuffled.
    """
    detail = [c for c in ("query",) if c in locks.columns]
    chosen = (
        _waiters(locks)
        .join(waiters.select("pid").distinct(), "pid", "left_semi")
        .select(
            "relation",
            F.col("lockmode").alias("wait_lockmode"),
            F.col("usename").alias("wait_user"),
            F.col("pid").alias("wait_procpid"),
            F.col("xact_start").alias("wait_start"),
            *[F.col(c).alias("wait_sql") for c in detail],
        )
    )
    held = lookup_join(_holders(locks), chosen, ["relation"]).filter(F.col("wait_start") > F.col("xact_start"))
    return held.select(
        F.col("relation").alias("lock_table"),
        "wait_lockmode",
        "wait_user",
        "wait_procpid",
        "wait_start",
        seconds_between(F.col("wait_start"), instant(as_of)).alias("wait_seconds"),
        *[F.col("wait_sql") for _ in detail],
        F.col("lockmode").alias("run_lockmode"),
        F.col("usename").alias("run_user"),
        F.col("pid").alias("run_procpid"),
        "xact_start",
        seconds_between(F.col("xact_start"), instant(as_of)).alias("xact_seconds"),
        *[F.col(c).alias("run_sql") for c in detail],
        *[F.col("state").alias("run_state") for c in ("state",) if c in locks.columns],
    )


def longest_lock_wait(locks: DataFrame, as_of: datetime) -> DataFrame:
    """The longest wait in whole minutes with both parties; one row, 0 when nobody waits."""
    oldest = _oldest_holder(locks)
    blocked = lookup_join(_waiters(locks), oldest, ["relation"]).filter(F.col("run.xact_start") < F.col("xact_start"))
    first = F.min(
        F.struct(
            F.col("xact_start").alias("wait_start"),
            F.col("pid").alias("wait_procpid"),
            F.col("relation").alias("lock_table"),
            F.col("usename").alias("wait_user"),
            F.col("run.pid").alias("run_procpid"),
            F.col("run.usename").alias("run_user"),
        )
    )
    return blocked.agg(first.alias("w")).select(
        "w.lock_table",
        "w.run_user",
        "w.run_procpid",
        "w.wait_user",
        "w.wait_procpid",
        F.coalesce(whole_minutes(F.col("w.wait_start"), instant(as_of)), F.lit(0)).alias("wait_minutes"),
    )
