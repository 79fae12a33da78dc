"""Changed tables as counter snapshots arrive."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from .runs import RunTable
from .sinks import run_batches

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
# Before everything in a list; where every search begins.
HEAD = -(1 << 63)
_LEVELS = 20
# Stands for a null counter on the way to the state: numbers beside nulls would become doubles in pandas.
_NO_COUNTER = HEAD
# Tables share the state of a bucket, so that a call and a look into the state serve many of them.
BUCKETS = 256
# Counters in a leaf, at most; a longer one is cut into halves of that.
LEAF = 256
# Bytes of a leaf's place when stored: one more than a table's and a time take, for the head.
_PLACE = 17
EVENTS = "reloid long, snapshot_us long, modcount long, reason string, version long"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which state per key needs."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def height(at: int) -> int:
    """Levels of a snapshot in the list, decided by its time alone: each further one for a quarter of them."""
    x = (at ^ (at >> 33)) * 0xFF51AFD7ED558CCD & (1 << 64) - 1
    x = (x ^ (x >> 33)) * 0xC4CEB9FE1A85EC53 & (1 << 64) - 1
    x ^= x >> 33
    return min(_LEVELS, 1 + ((x & -x).bit_length() - 1 if x else 63) // 2)


class SnapshotList:
    """A table's snapshots in time order: a skip list whose nodes lie in a map state, one entry per snapshot.

    A node is (modcount, the next snapshot on each of its levels); ``tails`` holds the last snapshot of each level,
    so a snapshot later than all others needs no search, and a late one finds its place in about log(n) steps.
    Only nodes that a batch touches are read, and those that it changes are written.
    """

    def __init__(self, load, tails: list[int] | None):
        self.load, self.nodes, self.changed, self.prior = load, {}, set(), {}
        self.tails = list(tails) if tails else [HEAD] * _LEVELS
        if not tails:
            self.nodes[HEAD] = [None, [None] * _LEVELS]
            self.changed.add(HEAD)

    def node(self, at: int) -> list | None:
        if at not in self.nodes:
            self.nodes[at] = self.load(at)
        return self.nodes[at]

    def before(self, at: int) -> list[int]:
        """Per level the last snapshot before ``at``."""
        if at > self.tails[0]:
            return list(self.tails)
        out, here = [HEAD] * _LEVELS, HEAD
        for level in range(_LEVELS - 1, -1, -1):
            while (following := self.node(here)[1][level]) is not None and following < at:
                here = following
            out[level] = here
        return out

    def put(self, at: int, modcount: int | None) -> list[int]:
        """Take in a counter; returns the snapshots whose event may be another now.  The largest counter counts."""
        earlier = self.before(at)
        found = self.node(earlier[0])[1][0]
        if found == at:
            own = self.node(at)
            if modcount is None or own[0] is not None and own[0] >= modcount:
                return []
            own[0] = modcount
        else:
            levels = height(at)
            own = self.nodes[at] = [modcount, [self.node(earlier[k])[1][k] for k in range(levels)]]
            for k in range(levels):
                self.node(earlier[k])[1][k] = at
                self.changed.add(earlier[k])
                if own[1][k] is None:
                    self.tails[k] = at
        self.changed.add(at)
        self.prior[at] = earlier[0]
        if own[1][0] is None:
            return [at]
        self.prior[own[1][0]] = at
        return [at, own[1][0]]

    def event(self, at: int) -> tuple[int | None, str | None]:
        """The counter of a touched snapshot, and ``new``, ``changed`` or null as it differs from the one before."""
        modcount, earlier = self.node(at)[0], self.prior[at]
        if earlier == HEAD:
            return modcount, "new"
        return modcount, None if self.node(earlier)[0] == modcount else "changed"


def _place(reloid: int, at: int) -> int:
    """One number in the order of tables and snapshots; all are above HEAD."""
    return (reloid - HEAD << 64) + at - HEAD


def _packed(places: list[int | None]) -> bytes:
    """Nothing follows: the head, which follows nothing."""
    return b"".join((0 if x is None else x - HEAD).to_bytes(_PLACE, "big") for x in places)


def _unpacked(raw: bytes) -> list[int]:
    return [int.from_bytes(raw[k : k + _PLACE], "big") + HEAD for k in range(0, len(raw), _PLACE)]


def _merged(old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counters (table, snapshot, counter) of both, in order, the largest of each snapshot; and which are new or larger."""
    both, fresh = np.concatenate((old, new), axis=1), np.repeat([False, True], [old.shape[1], new.shape[1]])
    order = np.lexsort((both[1], both[0]))  # stable: an old one before the new ones of its snapshot
    both, fresh = both[:, order], fresh[order]
    starts = np.flatnonzero(np.append(True, (both[:2, 1:] != both[:2, :-1]).any(axis=0)))
    most = np.maximum.reduceat(both[2], starts)
    return np.stack((*both[:2, starts], most)), fresh[starts] | (most > both[2, starts])


class CounterList:
    """The counters of a bucket's tables by table and snapshot, in leaves whose order a ``SnapshotList`` keeps.

    ``load`` gives what follows a leaf in that list, and its counters as three rows of numbers.  A leaf is named by
    the place that it begins at; the first one begins at the head.  Only leaves that a batch touches, and those on the
    way to them, are read, and those that it changes are written.
    """

    def __init__(self, load, tails: list[int] | None, leaf: int = LEAF):
        self.load, self.size, self.rows, self.changed = load, leaf, {}, set()
        self.order = SnapshotList(self._node, tails)
        if not tails:
            self.rows[HEAD] = np.zeros((3, 0), np.int64)

    def _node(self, start: int) -> list | None:
        found = self.load(start)
        if found is None:
            return None
        self.rows[start] = found[1]
        return [None, found[0]]

    def leaf(self, start: int) -> np.ndarray:
        self.order.node(start)
        return self.rows[start]

    def after(self, start: int) -> int | None:
        return self.order.node(start)[1][0]

    def add(self, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Take in counters; returns those whose event may be another now, which are a table's first, and which are as the one before."""
        new = new[:, np.lexsort((new[1], new[0]))]
        touched, at = {}, 0
        while at < new.shape[1]:
            start = self.order.before(_place(int(new[0, at]), int(new[1, at])) + 1)[0]
            end = self._until(new, self.after(start))
            self.rows[start], touched[start] = _merged(self.leaf(start), new[:, at:end])
            at = end
        self.changed.update(touched)
        events = self._events(touched)
        for start in touched:
            self._cut(start)
        return events

    def _until(self, new: np.ndarray, place: int | None) -> int:
        """How many of the sorted counters come before a place."""
        if place is None:
            return new.shape[1]
        reloid, at = (place >> 64) + HEAD, (place & (1 << 64) - 1) + HEAD
        first, last = np.searchsorted(new[0], np.int64(reloid)), np.searchsorted(new[0], np.int64(reloid), "right")
        return int(first + np.searchsorted(new[1, first:last], np.int64(at)))

    def _events(self, touched: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the leaves, and of the first counter of the next leaf where it follows a touched one."""
        follows = {self.after(start) for start, own in touched.items() if own[-1]} - {None}
        out = [self._compared(start, own, start in follows) for start, own in touched.items()]
        for start in follows - touched.keys():
            out.append(self._compared(start, np.zeros(self.leaf(start).shape[1], bool), True))
        return tuple(np.concatenate(x, axis=-1) for x in zip(*out))

    def _compared(self, start: int, own: np.ndarray, after_touched: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = self.leaf(start)
        before = np.zeros((3, 1), np.int64)
        if start != HEAD:
            before = self.leaf(self.order.before(start)[0])[:, -1:]
        before = np.concatenate((before, rows[:, :-1]), axis=1)
        first = rows[0] != before[0]
        first[0] |= start == HEAD
        chosen = own | np.append(after_touched, own[:-1]) & ~first
        return rows[:, chosen], first[chosen], (rows[2] == before[2])[chosen]

    def _cut(self, start: int) -> None:
        rows, half = self.rows[start], self.size // 2
        if rows.shape[1] <= self.size:
            return
        self.rows[start] = rows[:, :half]
        for k in range(half, rows.shape[1], half):
            place = _place(int(rows[0, k]), int(rows[1, k]))
            self.order.put(place, None)
            self.rows[place] = rows[:, k : k + half]

    def written(self) -> Iterator[tuple[int, list[int | None], np.ndarray]]:
        """The leaves to store, with what follows them."""
        for start in self.order.changed | self.changed:
            yield start, self.order.node(start)[1], self.leaf(start)


class _Changes(StatefulProcessor):
    """Events of a bucket's tables, numbered in the order in which they replace each other."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.leaves = handle.getMapState("leaves", "place binary", "following binary, counters binary")
        self.ends = handle.getValueState("ends", "tails binary, version long")

    def _load(self, start: int) -> tuple[list[int | None], np.ndarray] | None:
        found = self.leaves.getValue((_packed([start]),))
        if found is None:
            return None
        following = [None if x == HEAD else x for x in _unpacked(bytes(found[0]))]
        return following, np.frombuffer(bytes(found[1]), np.int64).reshape(3, -1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        tails, version = self.ends.get() if self.ends.exists() else (None, 0)
        known = CounterList(self._load, tails and _unpacked(bytes(tails)))
        for chunk in rows:
            version += 1
            found, first, same = known.add(chunk[["reloid", "snapshot_us", "modcount"]].to_numpy(np.int64).T)
            yield pd.DataFrame({
                "reloid": pd.arrays.IntegerArray(found[0], np.full(len(first), not key[0])),
                "snapshot_us": found[1],
                "modcount": pd.arrays.IntegerArray(found[2], found[2] == _NO_COUNTER),
                "reason": pd.Series(np.where(first, "new", np.where(same, None, "changed")), dtype=object),
                "version": np.full(len(first), version, np.int64),
            })
        for start, following, counters in known.written():
            self.leaves.updateValue((_packed([start]),), (_packed(following), counters.tobytes()))
        self.ends.update((_packed(known.order.tails), version))

    def close(self) -> None:
        pass


def stream_changed_tables(
    counters: DataFrame, out: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Every change of a table's counter from one snapshot to the next, and its first appearance.

    ``counters``: reloid, modcount, snapshot_ts (without time zone); rows without a time are left out.
    ``read_changes`` gives the events.  They do not depend on how snapshots fall into batches or on their order.
    The snapshots of tables are keyed state, so a batch costs what it brings: it reads and writes the neighbours of
    its snapshots, and emits anew the events of those and of what follows them.  Tables are dealt by hash into
    ``BUCKETS`` of state, which is fixed for a checkpoint.
    """
    spark = counters.sparkSession
    rows = counters.filter(F.col("snapshot_ts").isNotNull()).select(
        # Numbers beside nulls would become doubles in pandas; a table without a number has a bucket of its own.
        F.col("reloid").isNotNull().alias("named"),
        F.pmod(F.xxhash64(F.col("reloid").cast("long")), F.lit(BUCKETS)).alias("bucket"),
        F.coalesce(F.col("reloid").cast("long"), F.lit(0)).alias("reloid"),
        F.coalesce(F.col("modcount").cast("long"), F.lit(_NO_COUNTER)).alias("modcount"),
        F.unix_micros(F.col("snapshot_ts").cast("timestamp")).alias("snapshot_us"),
    )
    events = rows.groupBy("named", "bucket").transformWithStateInPandas(
        _Changes(), EVENTS, outputMode="Update", timeMode="None"
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        _events(batch.sparkSession, out).add(batch, batch_id)

    with keyed_state(spark):
        return run_batches(events, write, checkpoint, trigger, mode="update")


def _events(spark: SparkSession, out: str) -> RunTable:
    def last(events: DataFrame) -> DataFrame:
        value = F.max_by(F.struct("modcount", "reason"), "version").alias("value")
        found = events.groupBy("reloid", "snapshot_us").agg(value, F.max("version").alias("version"))
        return found.select("reloid", "snapshot_us", "value.modcount", "value.reason", "version")

    return RunTable(spark, f"{out}/events", last)


def changes(counters: DataFrame) -> DataFrame:
    """(reloid, modcount, snapshot_ts, reason) of each first counter and each one that differs from the one before.

    Of several counters of a table in one snapshot the largest counts.
    """
    before = F.lag("modcount").over(Window.partitionBy("reloid").orderBy("snapshot_ts"))
    first = F.row_number().over(Window.partitionBy("reloid").orderBy("snapshot_ts")) == 1
    one = counters.groupBy("reloid", "snapshot_ts").agg(F.max("modcount").alias("modcount"))
    found = one.withColumns({"first": first, "same": F.col("modcount").eqNullSafe(before)})
    return found.filter("first or not same").select(
        "reloid", "modcount", "snapshot_ts", F.when(F.col("first"), "new").otherwise("changed").alias("reason")
    )


def read_changes(spark: SparkSession, out: str) -> DataFrame:
    """(reloid, modcount, snapshot_ts, reason): the events that stand; none before the first batch."""
    events = _events(spark, out).read()
    if events is None:
        return spark.createDataFrame([], "reloid long, modcount long, snapshot_ts timestamp_ntz, reason string")
    return events.filter("reason is not null").select(
        "reloid", "modcount", F.timestamp_micros("snapshot_us").cast("timestamp_ntz").alias("snapshot_ts"), "reason"
    )
