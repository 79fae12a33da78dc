"""Logs and locks against brute force, with one key holding most of the rows."""

import random
from collections import defaultdict
from datetime import datetime, timedelta
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from clustervitals.operators import locks, logs, spread

NOW = datetime(2024, 1, 31)


@pytest.fixture(params=["broadcast", "split"])
def join_path(request, monkeypatch):
    if request.param == "split":
        monkeypatch.setattr(spread, "BROADCAST_BYTES", -1)
        monkeypatch.setattr(spread, "HOT_ROWS", 100)
    return request.param


def test_lookup_join_kinds(spark, join_path):
    facts = spark.range(0, 1000, 1, 7).select(F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id")).alias("k"), "id")
    lookup = spark.createDataFrame([(1, "hot"), (6, "cold")], "k long, v string")
    expected = {i: "hot" if i % 3 else "cold" for i in range(1000) if i % 3 or i == 6}
    assert {r.id: r.v for r in spread.lookup_join(facts, lookup, ["k"]).collect()} == expected
    semi = spread.lookup_join(facts, lookup.select("k"), ["k"], "left_semi")
    anti = spread.lookup_join(facts, lookup.select("k"), ["k"], "left_anti")
    assert semi.count() == len(expected) and anti.count() == 1000 - len(expected)
    assert semi.columns == anti.columns == ["k", "id"]


def test_only_hot_keys_of_a_lookup_are_repeated(spark, monkeypatch):
    monkeypatch.setattr(spread, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(spread, "HOT_ROWS", 100)
    kept = []
    monkeypatch.setattr(spread, "keep", lambda df: kept.append(df) or df)
    facts = spark.createDataFrame([(1,)] * 950 + [(2,)] * 100 + [(None,)] * 300, "k int")
    joined = spread.lookup_join(facts, spark.createDataFrame([(1,), (2,), (3,)], "k int"), ["k"])
    assert joined.count() == 1050
    assert {(r.k, r._splits) for r in kept[1].collect()} == {(1, 10), (None, 3)}


def test_running_total_cuts_hot_keys(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.8 else f"k{rng.randrange(20)}", i, rng.randrange(5)) for i in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, t long, v long").repartition(6)
    got = {(r.k, r.t): r.total for r in spread.running_total(df, ["k"], ["t"], "v", "total", partitions=16).collect()}
    sums, expected = defaultdict(int), {}
    for k, t, v in sorted(rows, key=lambda r: r[1]):
        sums[k] += v
        expected[k, t] = sums[k]
    assert got == expected


def test_running_total_spreads_a_hot_key(spark):
    df = spark.range(4000).select(F.lit("hot").alias("k"), F.col("id").alias("t"), F.lit(1).cast("long").alias("v"))
    sliced = df.repartitionByRange(8, "k", "t").withColumn("p", F.spark_partition_id()).groupBy("p").count()
    assert sliced.count() == 8 and sliced.agg(F.max("count")).first()[0] < 1500


def test_last_n_per_key(spark):
    df = spark.range(0, 5000, 1, 9).select(F.when(F.col("id") < 4000, 0).otherwise(F.col("id") % 3).alias("k"), "id")
    got = spread.last_n_per_key(df, ["k"], [F.desc("id")], 4, "n").collect()
    by_key = defaultdict(list)
    for i in range(5000):
        by_key[0 if i < 4000 else i % 3].append(i)
    expected = {(k, i, n) for k, ids in by_key.items() for n, i in enumerate(sorted(ids, reverse=True)[:4], 1)}
    assert {(r.k, r.id, r.n) for r in got} == expected


LOCK = "relation long, pid long, xact_start timestamp_ntz, usename string, granted boolean, lockmode string"


def random_locks(spark, n=600, seed=3):
    rng = random.Random(seed)
    rows = []
    for pid in range(n):
        relation = 1 if rng.random() < 0.6 else rng.randrange(2, 12)
        start = NOW - timedelta(seconds=rng.randrange(80))
        rows.append((relation, pid, start, f"u{pid % 5}", rng.random() < 0.7, rng.choice(["ShareLock", "ExclusiveLock", "RowLock"])))
    return rows, spark.createDataFrame(rows, LOCK).repartition(5)


def brute_pairs(rows):
    return [
        (w, h)
        for w in rows
        for h in rows
        if not w[4] and h[4] and w[5] != "ShareLock" and h[5] != "ShareLock" and w[0] == h[0] and h[2] < w[2]
    ]


def test_lock_waits_against_all_pairs(spark, join_path):
    rows, df = random_locks(spark)
    blockers = defaultdict(list)
    for w, h in brute_pairs(rows):
        blockers[w[1]].append((h[2], h[1]))
    got = {r.wait_procpid: (r.n_holders, r.xact_start, r.run_procpid) for r in locks.lock_waits(df, NOW).collect()}
    assert got == {pid: (len(b), *min(b)) for pid, b in blockers.items()}


def test_lock_wait_pairs(spark, join_path):
    rows, df = random_locks(spark, 200)
    expected = {(w[1], h[1]) for w, h in brute_pairs(rows)}
    got = locks.lock_wait_pairs(df, df.select("pid"), NOW)
    assert {(r.wait_procpid, r.run_procpid) for r in got.collect()} == expected
    total = locks.lock_waits(df, NOW).agg(F.sum("n_holders")).first()[0]
    assert total == len(expected)
    chosen = sorted({w for w, _ in expected})[:3]
    some = locks.lock_wait_pairs(df, spark.createDataFrame([(p,) for p in chosen], "pid long"), NOW)
    assert {(r.wait_procpid, r.run_procpid) for r in some.collect()} == {p for p in expected if p[0] in chosen}


def test_longest_lock_wait(spark, join_path):
    rows, df = random_locks(spark, 200)
    w = min((w[2], w[1]) for w, _ in brute_pairs(rows))
    row = locks.longest_lock_wait(df, NOW).first()
    assert row.wait_procpid == w[1]
    assert row.wait_minutes == round((NOW - w[0]).total_seconds() / 60)
    assert locks.longest_lock_wait(df.filter("granted"), NOW).first().wait_minutes == 0


def test_waiting_flag_and_query_text(spark):
    base = [(1, 1, NOW - timedelta(hours=2), "a", True, "X", False, "run", "active"), (1, 2, NOW - timedelta(hours=1), "b", False, "X", True, "w", "active"), (1, 3, NOW - timedelta(hours=1), "c", False, "X", False, "n", "idle")]
    df = spark.createDataFrame(base, LOCK + ", waiting boolean, query string, state string")
    (row,) = locks.lock_waits(df, NOW).collect()
    assert (row.wait_procpid, row.wait_sql, row.run_sql, row.run_state, row.wait_seconds) == (2, "w", "run", "active", 3600.0)
    (pair,) = locks.lock_wait_pairs(df, df.select("pid"), NOW).collect()
    assert (pair.wait_sql, pair.run_sql, pair.run_state) == ("w", "run", "active")


def test_lock_sessions(spark):
    pg_locks = spark.createDataFrame(
        [("relation", 20000, -1, 1, "X", True), ("relation", 100, -1, 1, "X", True), ("tuple", 20000, -1, 1, "X", True), ("relation", 20000, 0, 1, "X", True)],
        "locktype string, relation long, segid int, pid long, lockmode string, granted boolean",
    )
    activity = spark.createDataFrame([(1, "u", "active", False, NOW, "q" * 200)], "pid long, usename string, state string, waiting boolean, xact_start timestamp_ntz, query string")
    (row,) = locks.lock_sessions(pg_locks, activity).collect()
    assert row.relation == 20000 and len(row.query) == 100


def line(host, pid, ts, text, sess="con1", file="/d/gpseg0/pg_log/gpdb-2024-01-01_000000.csv"):
    return (f'{host}:{file}:{ts:%Y-%m-%d %H:%M:%S.%f} UTC,"u","db",p{pid},th1,"h","1",t,0,{sess},seg0,"{text}"',)


def test_crash_lines(spark):
    t = datetime(2024, 1, 1, 10)
    lines = spark.createDataFrame(
        [
            line("a", 7, t, 'PANIC","boom'),
            line("a", 7, t, "server process (PID 7) was terminated by signal 9"),
            line("a", 8, t, "server process (PID 8) was terminated by signal 11"),
            line("b", 7, t, "server process (PID 7) was terminated by signal 9"),
            line("a", 9, t, "EXECUTE E was terminated by signal (PID 9)"),
            ("garbage",),
        ],
        "log_msg string",
    )
    panics, terms = logs.panic_events(lines), logs.terminated_events(lines)
    (p,) = panics.collect()
    assert (p.hostname, p.pid, p.sess_id, p.logtime) == ("a", 7, "con1", "2024-01-01 10:00:00.000000 UTC")
    assert p.logmsg.startswith("2024-01-01") and p.logmsg.endswith('boom"')
    assert {(r.hostname, r.pid) for r in terms.collect()} == {("a", 7), ("a", 8), ("b", 7)}
    assert {(r.hostname, r.pid) for r in logs.terminated_without_panic(terms, panics).collect()} == {("a", 8), ("b", 7)}


def test_process_log_tail_against_brute_force(spark, join_path):
    rng = random.Random(5)
    base = datetime(2024, 1, 1)
    raw = []
    for i in range(900):
        pid = 1 if rng.random() < 0.7 else rng.randrange(2, 6)
        ts = base + timedelta(seconds=rng.randrange(120))
        raw += [line("h", pid, ts, f"m{rng.randrange(30)}")] * (rng.choice([1, 1, 1, 9]))
    terms = [("h", "/d/gpseg0/pg_log/gpdb-2024-01-01_000000.csv", f"{base + timedelta(seconds=s):%Y-%m-%d %H:%M:%S} UTC", pid) for s in range(-5, 130, 7) for pid in (1, 2, 3)]
    lines = spark.createDataFrame(raw, "log_msg string").repartition(6)
    events = spark.createDataFrame(terms, "hostname string, logfilename string, logtime string, pid int")
    for n in (1, 5, 50, 400):
        expected = []
        for host, file, logtime, pid in terms:
            until = datetime.strptime(logtime, "%Y-%m-%d %H:%M:%S UTC")
            mine = []
            for (text,) in raw:
                if f",p{pid}," in text:
                    ts = datetime.strptime(text.split(".csv:")[1].split(" UTC")[0], "%Y-%m-%d %H:%M:%S.%f")
                    if ts <= until:
                        mine.append((ts, md5(text.encode()).hexdigest(), text))
            for no, (_, _, text) in enumerate(sorted(mine, reverse=True)[:n], 1):
                expected.append((pid, logtime, no, text))
        got = [(r.pid, r.logtime, r.line_no, r.log_msg) for r in logs.process_log_tail(lines, events, n).collect()]
        assert sorted(got) == sorted(expected)


def test_session_log_tail_of_a_hot_session(spark, join_path):
    base = datetime(2024, 1, 1)
    raw = [line("h", 1, base + timedelta(seconds=i), f"m{i}", "con7") for i in range(500)]
    raw += [line("h", 1, base + timedelta(seconds=700), 'PANIC","x', "con7")] * 3
    raw += [line("h", 2, base + timedelta(seconds=i), "quiet", "con8") for i in range(50)]
    lines = spark.createDataFrame(raw, "log_msg string").repartition(7)
    got = logs.session_log_tail(lines, n=5).orderBy("line_no").collect()
    assert [r.sess_id for r in got] == ["con7"] * 5 and [r.line_no for r in got] == [1, 2, 3, 4, 5]
    assert ["PANIC" in r.log_msg for r in got] == [True] * 3 + [False] * 2
    assert got[3].log_msg.endswith('"m499"')


def test_pattern_counts(spark):
    t = datetime(2024, 1, 2)
    lines = spark.createDataFrame(
        [
            line("m", 1, t, 'PANIC","x'), line("s1", 1, t, 'PANIC","Unexpected internal error'), line("s2", 1, t, 'PANIC","y'),
            line("s2", 1, t - timedelta(microseconds=1), 'PANIC","before'), line("s1", 1, t, "fine"),
        ],
        "log_msg string",
    )
    got = {r.pattern: (r.matches, r.result, r.hosts) for r in logs.pattern_counts(lines, t, ["m"]).collect()}
    assert got == {
        "master_panic": (1, 1, "m"), "segment_panic": (2, 1, "s1,s2"), "internal_error": (1, 1, "s1"), "out_of_memory": (0, 0, ""),
    }


def test_last_checks(spark):
    history = spark.createDataFrame(
        [("m", datetime(2024, 1, 3, 4)), ("m", datetime(2024, 1, 2)), ("m", datetime(2025, 1, 1)), ("x", datetime(2024, 1, 30))],
        "metric_name string, ctime timestamp_ntz",
    )
    got = logs.last_checks(history, {"a": "m", "b": "other"}, datetime(2024, 1, 31, 9))
    assert got == {"a": datetime(2024, 1, 3, 4), "b": datetime(2024, 1, 31)}
