"""Files, sinks, streams against their batch operator, and plan shapes."""

import os
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from clustervitals.operators import change, monitor
from clustervitals.plans.queries import BUILDS
from clustervitals.plans.report import health_report
from clustervitals.sources import files, sinks, snapshots
from clustervitals.sources.workspace import fresh_dir, shared_dir
from clustervitals.streaming import changes, log_alerts, metrics
from clustervitals.streaming import sinks as stream_sinks

T0 = datetime(2024, 1, 1)


def test_shared_dir_follows_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert fresh_dir(spark, "x") != fresh_dir(spark, "x")


def test_file_inventory_of_nested_and_empty_files(spark, tmp_path):
    (tmp_path / "host=h1" / "gpseg3").mkdir(parents=True)
    (tmp_path / "host=h1" / "gpseg3" / "16384.1").write_bytes(b"x" * 10)
    (tmp_path / "other").write_bytes(b"")
    df = files.file_inventory(spark, str(tmp_path))
    got = {(r.filename, r.size_bytes, r.hostname, r.segid) for r in df.collect()}
    assert got == {("16384.1", 10, "h1", 3), ("other", 0, None, None)}
    deep = tmp_path / "a" / "b" / "c" / "d"
    deep.mkdir(parents=True)
    (deep / "e").write_bytes(b"12")
    assert files.file_inventory(spark, [str(tmp_path / "a"), f"file://{tmp_path}/host=h1"]).count() == 2


def test_listing_noise_and_rejects(spark):
    lines = [
        "total 12", "总用量 12", "", "   ", "/data/base/1:", "-????????? ? ? ? ? ? x",
        "-rw-------  1 dba  dba   42 2024-01-05_10:00:00 16384.1",
        "-rw------- one dba dba 42 2024-01-05_10:00:00 16385",
        "-rw------- 1 dba dba 42 2024-13-05_10:00:00 16386",
        "-rw------- 1 dba dba 42 2024-01-05_10:00:00 two words",
    ]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    (row,) = files.parse_file_listing(df).collect()
    assert (row.num, row.sysuser, int(row.size), row.modtime, row.filename) == (1, "dba", 42, datetime(2024, 1, 5, 10), "16384.1")
    assert {r.line for r in files.listing_rejects(df).collect()} == set(lines[-3:])


def test_log_lines_of_a_month(spark, tmp_path):
    for host, day in (("h1", "2024-01-05"), ("h2", "2024-01-06"), ("h2", "2024-02-01")):
        d = tmp_path / host / "gpseg0" / "pg_log"
        d.mkdir(parents=True, exist_ok=True)
        (d / f"gpdb-{day}_000000.csv").write_text(f'{day} 00:00:00 UTC,"u"\n')
    got = {r.log_msg for r in files.log_lines(spark, str(tmp_path), "2024-01").collect()}
    assert got == {
        'h1:/gpseg0/pg_log/gpdb-2024-01-05_000000.csv:2024-01-05 00:00:00 UTC,"u"',
        'h2:/gpseg0/pg_log/gpdb-2024-01-06_000000.csv:2024-01-06 00:00:00 UTC,"u"',
    }
    assert files.log_lines(spark, str(tmp_path), "2024-01-06").count() == 1
    by_uri = files.log_lines(spark, f"file://{tmp_path}/", "2024-01").collect()
    assert {r.log_msg for r in by_uri} == got
    with pytest.raises(ValueError):
        files.log_lines(spark, str(tmp_path), "2024")


@pytest.mark.parametrize("name", ["my logs", "a+b%20c", "logs/logs", "é"])
def test_log_lines_below_any_root(spark, tmp_path, name):
    root = tmp_path / name
    d = root / "logs" / "logs" / "x y"
    d.mkdir(parents=True)
    (d / "gpdb-2024-01-05_000000.csv").write_text('2024-01-05 00:00:00 UTC,"u"\n')
    for at in (str(root), f"{root}/"):
        (row,) = files.log_lines(spark, at, "2024-01-05").collect()
        assert row.log_msg == 'logs:/logs/x y/gpdb-2024-01-05_000000.csv:2024-01-05 00:00:00 UTC,"u"'


def test_partitioned_logs_prune_dates(spark, tmp_path):
    df = spark.createDataFrame([("a", "2024-01-05", "h"), ("b", "2024-02-05", "h")], "log_msg string, dt string, host string")
    df.write.partitionBy("dt", "host").text(str(tmp_path / "log"))
    got = files.partitioned_log_lines(spark, str(tmp_path / "log"), "2024-01")
    assert [r.log_msg for r in got.collect()] == ["a"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*StartsWith\(dt", plan)
    since = files.log_lines_between(spark, str(tmp_path / "log"), datetime(2024, 1, 5, 23), datetime(2024, 2, 4))
    assert [r.log_msg for r in since.collect()] == ["a"]
    assert re.search(r"PartitionFilters: \[[^\]]*dt", since._jdf.queryExecution().executedPlan().toString())


def history(spark, rows):
    return spark.createDataFrame(rows, "ctime timestamp_ntz, metric_name string, monitor_result string, status int")


def test_report_is_replaced_and_history_appended(spark, tmp_path):
    df = history(spark, [(T0, "a", "1", 2)])
    for _ in range(2):
        sinks.save_report(df, str(tmp_path / "r"))
        sinks.append_history(df, str(tmp_path / "h"))
    assert spark.read.parquet(str(tmp_path / "r")).count() == 1
    assert spark.read.parquet(str(tmp_path / "h")).count() == 2
    kept = monitor.apply_retention(spark.read.parquet(str(tmp_path / "h")), T0 + timedelta(days=181))
    assert kept.count() == 0 and "PartitionFilters: [isnotnull(dt" in kept._jdf.queryExecution().executedPlan().toString()


def test_metric_text_is_replaced(spark, tmp_path):
    out = tmp_path / "text"
    sinks.export_metric_text(history(spark, [(T0, "a", "1", 2), (T0 + timedelta(1), "a", "2", 2), (T0, "c", None, 3), (T0, "d", "", 3)]), str(out))
    assert {f.name for f in out.iterdir()} == {"a.txt"} and (out / "a.txt").read_text() == "2"
    sinks.export_metric_text(history(spark, [(T0, "a", "9", 2), (T0, "x/y z", "5", 2)]), str(out))
    assert not list(out.glob("*.tmp"))
    assert {r.metric_name: r.monitor_result for r in sinks.read_metric_text(spark, str(out)).collect()} == {"a": "9", "x/y z": "5"}


def test_snapshots_take_the_newest_complete_version(spark, tmp_path):
    root = str(tmp_path / "state")
    with pytest.raises(FileNotFoundError):
        snapshots.read_snapshot(spark, root)
    assert snapshots.write_snapshot(spark.range(1), root) == 0
    grown = snapshots.read_snapshot(spark, root).unionByName(spark.range(5, 7))
    assert snapshots.write_snapshot(grown, root) == 1
    (tmp_path / "state" / "version=2").mkdir()
    assert sorted(r.id for r in snapshots.read_snapshot(spark, root).collect()) == [0, 5, 6]
    assert snapshots.write_snapshot(spark.range(2), root) == 2 and snapshots.last_version(root) == 2


def test_stream_log_alerts_over_three_files(spark, tmp_path):
    def text(i):
        ts = T0 + timedelta(minutes=i)
        body = 'PANIC","Unexpected internal error' if i % 3 == 0 else "Out of memory" if i % 3 == 1 else "ok"
        return f'h{i % 2}:/f.csv:{ts:%Y-%m-%d %H:%M:%S} UTC,"u","db",p1,th1,"h","1",t,0,con1,seg0,"{body}"'

    src = tmp_path / "in"
    src.mkdir()
    for part in range(3):
        file = src / f"{part}.txt"
        file.write_text("\n".join(text(i) for i in range(part * 20, part * 20 + 20)) + "\n")
        os.utime(file, (1_700_000_000 + part, 1_700_000_000 + part))
    stream = log_alerts.log_alerts(log_alerts.stream_log_lines(spark, str(src), max_files=1), ["h0"])
    out = str(tmp_path / "out")
    query = stream_sinks.run_updates(stream, out, str(tmp_path / "cp"))
    query.awaitTermination()
    assert spark.read.parquet(out).select("batch").distinct().count() >= 3
    keys = ["window_start", "window_end", "hostname", "pattern"]
    got = stream_sinks.read_updates(spark, out, keys).collect()
    batch = log_alerts.log_alerts(spark.read.text(str(src)).withColumnRenamed("value", "log_msg"), ["h0"]).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, batch)) and got


def test_late_log_lines_are_dropped_by_a_stream_only(spark, tmp_path):
    def text(minute):
        return f'h:/f.csv:{T0 + timedelta(minutes=minute):%Y-%m-%d %H:%M:%S} UTC,"u","db",p1,th1,"h","1",t,0,con1,seg0,"Out of memory"\n'

    src = tmp_path / "in"
    src.mkdir()
    for part, minutes in enumerate([(0, 60), (61,), (49, 62), (52, 3)]):
        file = src / f"{part}.txt"
        file.write_text("".join(text(m) for m in minutes))
        os.utime(file, (1_700_000_000 + part, 1_700_000_000 + part))
    stream = log_alerts.log_alerts(log_alerts.stream_log_lines(spark, str(src), max_files=1))
    out = str(tmp_path / "out")
    stream_sinks.run_updates(stream, out, str(tmp_path / "cp")).awaitTermination()
    got = stream_sinks.read_updates(spark, out, ["window_start", "window_end", "hostname", "pattern"]).collect()
    # The watermark of minute 60 drops lines from the second batch after it: 49 and 3 come too late, 52 does not.
    assert {(r.window_start - T0).seconds // 60: r.matches for r in got} == {0: 1, 50: 1, 60: 3}
    batch = log_alerts.log_alerts(spark.read.text(str(src)).withColumnRenamed("value", "log_msg"))
    assert batch.agg(F.sum("matches")).first()[0] == 7


def test_every_log_line_is_accounted_for(spark, tmp_path):
    def text(minute, body="Out of memory"):
        return f'h:/f.csv:{T0 + timedelta(minutes=minute):%Y-%m-%d %H:%M:%S} UTC,"u","db",p1,th1,"h","1",t,0,con1,seg0,"{body}"'

    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    # Minute 60 of the second batch makes minutes before 50 late from the third batch on; a line without match counts as time.
    batches = [[text(0), "no time"], [text(60, "ok"), text(1)], [text(49), text(50), text(61), ""], [text(3), text(62)], ["x"]]
    for k, lines in enumerate(batches):
        (src / f"{k}.txt").write_text("\n".join(lines) + "\n")
        stream = log_alerts.stream_log_lines(spark, str(src))
        log_alerts.stream_log_alerts(stream, out, str(tmp_path / "cp")).awaitTermination()
    account = [tuple(r) for r in log_alerts.read_account(spark, out).orderBy("batch").collect()]
    assert account == [(0, 2, 1, 0, 1), (1, 2, 2, 0, 0), (2, 4, 2, 1, 1), (3, 2, 1, 1, 0), (4, 1, 0, 0, 1)]
    aside = {(r.log_msg, r.kind) for r in log_alerts.read_aside(spark, out).collect()}
    assert aside == {("no time", "unparsable"), ("", "unparsable"), ("x", "unparsable"), (text(49), "late"), (text(3), "late")}

    def windows(df):
        return {(r.window_start - T0).seconds // 60: r.matches for r in df.collect()}

    assert windows(log_alerts.read_alerts(spark, out)) == {0: 2, 50: 1, 60: 2}
    assert windows(log_alerts.read_alerts(spark, out, with_late=True)) == {0: 3, 45: 1, 50: 1, 60: 2}
    assert log_alerts.read_alerts(spark, str(tmp_path / "none")) is None


def test_stream_latest_metrics_over_three_files(spark, tmp_path):
    rows = [(T0 + timedelta(hours=i), f"m{i % 3}", str(i), 2) for i in range(12)]
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (rows[8:], rows[:4], rows[4:8]):
        history(spark, part).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(history(spark, []).schema).parquet(src)
        metrics.stream_latest_metrics(stream, out, str(tmp_path / "cp"), str(tmp_path / "text")).awaitTermination()
    newest = metrics.read_latest(spark, out)
    want = monitor.latest_metrics(history(spark, rows))
    assert sorted(map(tuple, newest.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert spark.read.parquet(f"{out}/history").count() == 12
    assert (tmp_path / "text" / "m2.txt").read_text().strip() == "11"


@pytest.mark.parametrize("files", [[0, 1, 2, 3], [0, 0, 0, 0], [1, 0, 1, 0], [3, 2, 1, 0]])
def test_stream_metric_results_measures_every_snapshot(spark, tmp_path, files):
    schema = "snapshot_ts timestamp_ntz, state string, waiting boolean, query_start timestamp_ntz"
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    later = T0 + timedelta(minutes=5)
    rows = [
        (T0, "active", False, T0 - timedelta(minutes=9)), (T0, "idle", False, T0),
        (later, "active", True, T0), (later - timedelta(minutes=1), "active", False, T0),
    ]
    for k in sorted(set(files)):
        spark.createDataFrame([r for r, f in zip(rows, files) if f == k], schema).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        metrics.stream_metric_results(stream, out, str(tmp_path / "cp"), str(tmp_path / "text")).awaitTermination()
    rows = metrics.read_results(spark, out).collect()
    got = {(r.ctime, r.metric_name): r.monitor_result for r in rows}
    assert len(rows) == len(got) == 15
    assert (got[T0, "gpdb_total_connections"], got[T0, "gpdb_long_sql_running_time"]) == ("2", "9")
    assert (got[later, "gpdb_total_connections"], got[later, "gpdb_total_waiting_sql"]) == ("1", "1")
    assert got[later - timedelta(minutes=1), "gpdb_long_sql_running_time"] == "4"
    assert (tmp_path / "text" / "gpdb_long_sql_running_time.txt").read_text() == "5"


@pytest.mark.parametrize("files", [[0, 0, 1, 1, 1, 1, 2, 2], [0] * 8, [2, 2, 1, 0, 0, 1, 0, 2], [0, 1, 2, 3, 4, 5, 6, 7]])
def test_stream_changed_tables_does_not_depend_on_batches(spark, tmp_path, files):
    schema = "reloid long, modcount long, snapshot_ts timestamp_ntz"
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    day = [T0 + timedelta(k) for k in range(4)]
    rows = [(1, 5, day[0]), (2, 5, day[0]), (1, 9, day[1]), (2, 5, day[1]), (1, 5, day[2]), (3, 1, day[1]), (1, 5, day[3]), (2, 7, day[3])]
    for k in sorted(set(files)):
        spark.createDataFrame([r for r, f in zip(rows, files) if f == k], schema).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        changes.stream_changed_tables(stream, out, str(tmp_path / "cp")).awaitTermination()
    got = {(r.reloid, r.modcount, r.snapshot_ts, r.reason) for r in changes.read_changes(spark, out).collect()}
    assert got == {
        (1, 5, day[0], "new"), (2, 5, day[0], "new"), (1, 9, day[1], "changed"), (3, 1, day[1], "new"),
        (1, 5, day[2], "changed"), (2, 7, day[3], "changed"),
    }


def test_stream_state_agrees_with_batch(spark, tmp_path):
    old = spark.createDataFrame([(1, 5, T0)], "reloid long, modcount long, last_checktime timestamp_ntz")
    new = spark.createDataFrame([(1, 6), (2, 1)], "reloid long, modcount long")
    live = spark.createDataFrame([(1,), (2,)], "reloid long")
    moved = change.changed_tables(old, new)
    assert {r.reloid for r in change.refresh_state(old, moved, live, T0).collect()} == {1, 2}


def test_health_report_without_inputs_for_most_sections(spark):
    conf = spark.createDataFrame([(0, "p", "p", "u", "s", "h")], "content int, role string, preferred_role string, status string, mode string, hostname string")
    got = [(r.ordinal, r.section, r.key, r.value) for r in health_report({"conf": conf}, T0, 1).collect()]
    assert got == [
        (1, "segments down", "instances", "0"), (2, "segments out of sync", "instances", "0"), (3, "roles switched", "instances", "0"),
        (4, "cluster", "segment_hosts", "1"), (4, "cluster", "primary_segments", "1"),
    ]


# Node names that must not appear in any batch plan.
BAD_NODES = ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "BatchEvalPython", "ArrowEvalPython", "MapInPandas")


@pytest.mark.parametrize("name", sorted(n for n in BUILDS if not n.startswith("stream_") and n != "file_inventory"))
def test_plans_stay_in_the_jvm_without_cross_joins(spark, name):
    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not [bad for bad in BAD_NODES if bad in plan]


def plan_of(spark, name):
    return entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["top_append_only", "top_heap", "top_partitioned", "segment_age", "high_age_relations", "subpartition_counts"])
def test_top_lists_do_not_sort_everything(spark, name):
    assert "TakeOrderedAndProject" in plan_of(spark, name)


def test_tails_are_cut_before_the_shuffle(spark):
    # One ranking up to the group limit, cut in every task before the rows move.
    assert plan_of(spark, "session_log_tail").count("row_number(), 100, Partial") == 1


@pytest.mark.parametrize("name", ["session_log_tail", "terminated_without_panic", "operation_history", "lock_waits"])
def test_small_lookups_are_broadcast(spark, name):
    plan = plan_of(spark, name)
    assert "BroadcastHashJoin" in plan


@pytest.mark.parametrize("name", sorted(n for n in BUILDS if not n.startswith("stream_")))
def test_no_window_runs_over_all_rows(spark, name):
    # A window without partition keys prints an empty list before its order.
    assert not re.search(r"Window \[.*\], \[\], \[", plan_of(spark, name))


def test_skew_check_aggregates_by_hash(spark):
    plan = plan_of(spark, "skew_report")
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_scans_read_only_needed_columns(spark):
    plan = entry.queries()["session_metrics"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "props" not in re.search(r"ReadSchema: struct<([^>]*)>", plan)[1]


def test_filters_reach_the_scan(spark):
    plan = entry.queries()["apply_retention"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan


def test_sources_survive_no_matching_rows(spark):
    empty = spark.createDataFrame([], "line string")
    assert files.parse_file_listing(empty).isEmpty() and files.listing_rejects(empty).isEmpty()
    union = files.segment_union(spark.range(1), spark.range(2).withColumn("segid", F.lit(4)))
    assert sorted(r.segid for r in union.collect()) == [-1, 4, 4]
