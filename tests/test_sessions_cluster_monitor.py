"""Boundary cases of sessions, cluster state, privileges and monitoring."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from clustervitals.functions import acl
from clustervitals.operators import cluster, monitor, privileges, sessions

NOW = datetime(2024, 1, 31)
HOUR = timedelta(hours=1)
ACTIVITY = (
    "pid long, sess_id long, usename string, state string, waiting boolean, query_start timestamp_ntz, "
    "xact_start timestamp_ntz, state_change timestamp_ntz, query string"
)


def activity(spark, rows):
    return spark.createDataFrame(
        [(i, i, "u", state, waiting, NOW - q, NOW - x, None if c is None else NOW - c, "q" * 150) for i, state, waiting, q, x, c in rows],
        ACTIVITY,
    )


def test_metrics_of_nothing(spark):
    empty = activity(spark, [])
    got = {r.metric_name: r.result for r in sessions.session_metrics(empty, NOW).collect()}
    assert set(got.values()) == {0} and len(got) == 5
    assert float(sessions.top_workfile(spark.createDataFrame([], "pid long, sess_id long, usename string, segid int, size_bytes long")).first().workfile_gb) == 0.0
    totals = sessions.resource_group_totals(spark.createDataFrame([], "num_running int, num_queueing int")).first()
    assert (totals.running, totals.queueing) == (0, 0)


def test_longest_sql_rounds_to_even(spark):
    for seconds, minutes in ((90, 2), (150, 2), (151, 3), (29, 0)):
        df = activity(spark, [(1, "active", False, timedelta(seconds=seconds), HOUR, HOUR), (2, "idle", False, 99 * HOUR, HOUR, HOUR)])
        assert sessions.longest_sql_minutes(df, NOW).first()[0] == minutes


def test_idle_limits_are_strict(spark):
    day = 24 * HOUR
    tick = timedelta(microseconds=1)
    rows = [
        (1, "idle in transaction", False, HOUR, day, HOUR),
        (2, "idle in transaction", False, HOUR, day + tick, HOUR),
        (3, "idle in transaction", False, day + tick, HOUR, None),
        (4, "active", False, day + tick, day * 2, day * 2),
    ]
    df = activity(spark, rows)
    assert {r.pid for r in sessions.long_idle_transactions(df, NOW).collect()} == {2, 3}
    (long,) = sessions.long_queries(df, NOW).collect()
    assert long.pid == 4 and len(long.query) == 100


def test_idle_session_candidates(spark):
    rows = [
        (1, "idle in transaction", False, HOUR, 2 * HOUR, 4 * HOUR),
        (2, "idle", False, 25 * HOUR, HOUR, 11 * HOUR),
        (3, "idle", False, HOUR, HOUR, 13 * HOUR),
        (4, "active", False, 99 * HOUR, 99 * HOUR, 99 * HOUR),
    ]
    df = activity(spark, rows)
    now = {r.pid: r.reason for r in sessions.idle_session_candidates(df, NOW).collect()}
    old = {
        r.pid: r.reason
        for r in sessions.idle_session_candidates(df, NOW, HOUR, 24 * HOUR, by_state_change=False).collect()
    }
    assert now == {1: "idle in transaction", 3: "idle"}
    assert old == {1: "idle in transaction", 2: "idle"}


def test_orphan_temp_schemas(spark):
    ns = spark.createDataFrame([("pg_temp_1", -1), ("pg_temp_1", 0), ("pg_toast_temp_2", 0), ("pg_temp_3", 0), ("pg_temp_1x", 0), ("pgXtemp_9", 0)], "nspname string, segid int")
    live = activity(spark, [(3, "idle", False, HOUR, HOUR, HOUR)])
    assert {r.nspname for r in sessions.orphan_temp_schemas(ns, live).collect()} == {"pg_temp_1", "pg_toast_temp_2"}


def test_small_workfile_rounds_to_zero(spark):
    df = spark.createDataFrame([(1, 1, "u", 0, 5_000_000), (2, 1, "u", 0, 4_000_000)], "pid long, sess_id long, usename string, segid int, size_bytes long")
    row = sessions.top_workfile(df).first()
    assert (row.pid, float(row.workfile_gb)) == (1, 0.0)


CONF = "content int, role string, preferred_role string, status string, mode string, hostname string"


def test_cluster_state(spark):
    df = spark.createDataFrame(
        [(-1, "p", "p", "u", "n", "m"), (0, "p", "m", "u", "s", "a"), (0, "m", "p", "d", "n", "b")], CONF
    )
    assert tuple(cluster.segments_down(df).first()) == (1, 1)
    assert tuple(cluster.segments_out_of_sync(df).first()) == (1, 1)
    assert tuple(cluster.role_switched(df).first()) == (2, 1)
    assert tuple(cluster.cluster_shape(df).first()) == (2, 1)
    assert tuple(cluster.segments_down(df.limit(0)).first()) == (0, 0)


def test_acl_decoding(spark):
    items = ["owner=arwdD/owner", "=r/owner", "bob=x/owner", "amy=UC/owner", None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(items)], "i int, item string")
    got = df.orderBy("i").select(acl.acl_role(F.col("item")), acl.acl_table(F.col("item")), acl.acl_schema(F.col("item"))).collect()
    assert [tuple(r) for r in got] == [
        ("owner", "Select;Insert;Update;Delete;Truncate;", ""),
        ("public", "Select;", ""),
        ("bob", "", ""),
        ("amy", "", "Usage;Create;"),
        ("", "", ""),
    ]


def test_exact_privilege(spark):
    lists = [None, [], ["a=r/o", "=r/o", "b=rw/o"], ["b=rw/o"]]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(lists)], "i int, acl array<string>")
    got = [r[0] for r in df.orderBy("i").select(acl.roles_with_exact_privilege(F.col("acl"), "r")).collect()]
    assert got == ["", "", "a;public", None]


def test_table_privileges_null_and_empty_lists(spark):
    rows = [("s", "nolist", "r", "own", None), ("s", "empty", "r", "own", []), ("s", "x", "v", "own", ["bob=x/own"]), ("s", "p_1_prt_1", "r", "own", None), ("s", "idx", "i", "own", None)]
    df = spark.createDataFrame(rows, "schemaname string, tablename string, relkind string, rolname string, relacl array<string>")
    got = {(r.tablename, r.tabletype, r.rolname, r.isowner, r.privelege) for r in privileges.table_privileges(df).collect()}
    assert got == {
        ("nolist", "Table", "own", "TRUE", "Select;Insert;Update;Delete;Truncate;"),
        ("x", "View", "bob", "FALSE", ""),
    }


def test_due_metrics(spark):
    ran = NOW - timedelta(minutes=5)
    rows = [
        (1, "m", 5, 0, None), (2, "m", 5, 1, ran - timedelta(seconds=1)), (3, "m", 5, 1, ran), (4, "m", 5, 2, ran),
        (5, "m", 5, 2, ran - timedelta(seconds=1)), (6, "m", 5, 3, None), (7, "m", 5, 9, None),
    ]
    df = spark.createDataFrame(rows, "monitor_id int, metric_name string, check_interval int, status int, last_finishtime timestamp_ntz")
    got = {r.monitor_id: (r.due, r.error, r.stuck) for r in monitor.due_metrics(df, NOW).collect()}
    assert got == {
        1: (True, None, False), 2: (False, None, True), 3: (False, None, False), 4: (False, None, False),
        5: (True, None, False), 6: (True, None, False), 7: (False, "invalid status", False),
    }


def test_a_round_of_checks(spark):
    ran = NOW - timedelta(hours=1)
    rows = [(1, "a", 5, 0, None), (2, "b", 5, 2, ran), (3, "c", 90, 2, ran)]
    setup = spark.createDataFrame(rows, "monitor_id int, metric_name string, check_interval int, status int, last_finishtime timestamp_ntz")

    def state(df):
        return {r.metric_name: (r.status, r.last_finishtime) for r in df.collect()}

    started = monitor.start_checks(setup, NOW)
    assert state(started) == {"a": (1, NOW), "b": (1, NOW), "c": (2, ran)}
    assert monitor.due_metrics(started, NOW).filter("due").isEmpty()
    later = NOW + timedelta(minutes=1)
    results = spark.createDataFrame([("a", 2), ("b", 3)], "metric_name string, status int")
    ended = monitor.record_results(started, results, later)
    assert state(ended) == {"a": (2, later), "b": (3, later), "c": (2, ran)} and ended.columns == setup.columns
    assert state(monitor.reset_checks(ended)) == {"a": (0, None), "b": (0, None), "c": (0, None)}


def test_retention_keeps_the_boundary(spark):
    edge = NOW - timedelta(days=180)
    df = spark.createDataFrame([(edge,), (edge - timedelta(microseconds=1),)], "ctime timestamp_ntz")
    assert [r.ctime for r in monitor.apply_retention(df, NOW).collect()] == [edge]


def test_alerts_need_numbers(spark):
    latest = spark.createDataFrame([("a", "1"), ("b", "0"), ("c", "oops"), ("d", "5"), ("e", "7")], "metric_name string, monitor_result string")
    setup = spark.createDataFrame([("a", True, "1"), ("b", True, "1"), ("c", True, "1"), ("d", False, "1"), ("e", True, "")], "metric_name string, if_warning boolean, warning_value string")
    got = {r.metric_name: r.alert for r in monitor.evaluate_alerts(latest, setup).collect()}
    assert got == {"a": True, "b": False, "c": False, "e": False}
