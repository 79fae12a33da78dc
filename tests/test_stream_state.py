"""State of streams: keyed snapshots, merged runs, and what they cost as batches add up."""

import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from clustervitals.streaming import changes
from clustervitals.streaming.runs import RunTable

T0 = datetime(2024, 1, 1)
SCHEMA = "reloid long, modcount long, snapshot_ts timestamp_ntz"


def test_snapshot_list_in_any_order():
    rng = random.Random(5)
    for n in (1, 2, 30, 400):
        state, tails, counters, reads = {}, None, {}, 0
        order = rng.sample(range(10 * n), n)
        events = {}
        for at in order:
            loads = []
            known = changes.SnapshotList(lambda k: loads.append(k) or state.get(k), tails)
            for value in rng.choice([[1], [None], [None, 2], [2, 1]]):
                for touched in known.put(at, value):
                    events[touched] = None
                counters[at] = max((v for v in (counters.get(at), value) if v is not None), default=None)
            for touched in [e for e, v in events.items() if v is None]:
                events[touched] = known.event(touched)
            for k in known.changed:
                state[k] = [known.nodes[k][0], list(known.nodes[k][1])]
            tails, reads = known.tails, reads + len(loads)
        times = sorted(counters)
        want = {
            t: (counters[t], "new" if k == 0 else "changed" if counters[t] != counters[times[k - 1]] else None)
            for k, t in enumerate(times)
        }
        assert events == want
        assert reads < 40 * n


def test_a_snapshot_in_order_costs_the_same_after_many():
    state, tails, costs = {}, None, []
    for at in range(3000):
        loads = []
        known = changes.SnapshotList(lambda k: loads.append(k) or state.get(k), tails)
        for touched in known.put(at, at % 3):
            known.event(touched)
        state.update({k: [known.nodes[k][0], list(known.nodes[k][1])] for k in known.changed})
        tails = known.tails
        costs.append((len(loads), len(known.changed)))
    # A node, and one before it for each of its levels.
    assert sum(a + b for a, b in costs[-100:]) <= 1.5 * sum(a + b for a, b in costs[100:200])


def test_counter_list_in_any_order():
    rng = random.Random(6)
    for n, leaf in ((1, 4), (30, 4), (400, 8), (400, 1000)):
        state, tails, counters, events = {}, None, {}, {}
        for _ in range(12):
            known = changes.CounterList(state.get, tails, leaf)
            for _ in range(rng.choice([1, 2])):
                rows = [(rng.choice([-(2**63), -5, 1, 2**63 - 1]), rng.randrange(n), rng.choice([changes.HEAD, 1, 2, 2**60])) for _ in range(n)]
                for reloid, at, value in rows:
                    counters[reloid, at] = max(counters.get((reloid, at), value), value)
                found, first, same = known.add(np.array(rows, np.int64).T)
                events.update({(r, a): (m, f, s and not f) for (r, a, m), f, s in zip(found.T.tolist(), first.tolist(), same.tolist())})
            state.update({start: (list(following), rows.copy()) for start, following, rows in known.written()})
            tails = known.order.tails
        keys = sorted(counters)
        want = {}
        for before, key in zip([None, *keys], keys):
            first = before is None or before[0] != key[0]
            want[key] = (counters[key], first, not first and counters[before] == counters[key])
        assert events == want
        assert max(rows.shape[1] for _, rows in state.values()) <= leaf


class _Handle:
    """State of one bucket that counts the looks into it."""

    def __init__(self):
        self.calls, self.maps, self.value = 0, {}, None

    def getMapState(self, *_):
        return self

    getValueState = getMapState

    def getValue(self, key):
        self.calls += 1
        return self.maps.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self.maps[key] = value

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def test_many_tables_share_calls_and_looks_into_the_state():
    handle, tables = _Handle(), 20_000
    for at in (0, 2, 1):
        process, before = changes._Changes(), handle.calls
        process.init(handle)
        chunks = [pd.DataFrame({"reloid": np.arange(k, tables, 2), "snapshot_us": at, "modcount": at}) for k in (0, 1)]
        assert sum(map(len, process.handleInputRows((True, 0), iter(chunks), None))) >= tables
        # Two counters at least a table before: its ends, and the snapshots beside the new one.
        assert handle.calls - before < tables / 10


def test_stream_with_nulls_repeats_and_one_batch_for_all(spark, tmp_path):
    rows = [
        (1, 5, T0), (1, None, T0 + timedelta(1)), (1, 5, T0 + timedelta(2)), (1, 5, T0 + timedelta(2)), (1, 4, T0 + timedelta(2)),
        (None, 1, T0), (None, None, T0 - timedelta(1)), (2, None, T0), (3, 1, None), (4, 2**60 + 1, T0), (4, None, T0 + timedelta(1)),
    ]
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (rows[::2], rows[1::2], rows[:3], []):
        spark.createDataFrame(part, SCHEMA).write.mode("append").parquet(src)
        stream = spark.readStream.schema(SCHEMA).parquet(src)
        changes.stream_changed_tables(stream, out, str(tmp_path / "cp")).awaitTermination()
    want = changes.changes(spark.createDataFrame([r for r in rows if r[2]], SCHEMA))
    assert sorted(map(str, changes.read_changes(spark, out).collect())) == sorted(map(str, want.collect()))
    assert changes.read_changes(spark, str(tmp_path / "nothing")).isEmpty()


def totals(df):
    return df.groupBy("k").agg(F.max("v").alias("v"))


def test_runs_stay_few_and_old_ones_go(spark, tmp_path):
    table = RunTable(spark, str(tmp_path / "t"), totals, fan=3)
    for batch in range(30):
        table.add(spark.createDataFrame([(batch % 4, batch), (9, -batch)], "k long, v long").coalesce(1), batch, {"at": batch})
        runs, note = table.state()
        assert note == {"at": batch} and len(runs) <= 2 * 4
    assert {tuple(r) for r in table.read().collect()} == {(0, 28), (1, 29), (2, 26), (3, 27), (9, 0)}
    assert table.versions() == [28, 29]
    folders = [f for f in (tmp_path / "t").iterdir() if f.name.startswith("run-")]
    assert len(folders) <= 2 * 9
    # The version before the last one can still be read.
    assert {tuple(r) for r in table.read(before=29).collect()} == {(0, 28), (1, 25), (2, 26), (3, 27), (9, 0)}


def test_a_repeated_batch_replaces_its_own_rows(spark, tmp_path):
    table = RunTable(spark, str(tmp_path / "t"), totals, fan=2)
    assert table.read() is None
    for batch, value in ((0, 1), (1, 7), (1, 5), (2, 2), (2, 3), (2, 3)):
        table.add(spark.createDataFrame([(1, value)], "k long, v long"), batch)
    assert [tuple(r) for r in table.read().collect()] == [(1, 5)]
    table.add(spark.createDataFrame([], "k long, v long"), 3)
    assert [tuple(r) for r in table.read().collect()] == [(1, 5)]
