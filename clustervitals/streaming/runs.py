"""A table that grows batch by batch and stays a bounded number of folders.

A batch adds a run (a folder of rows).  When ``FAN`` runs of a level are there,
they are merged into one of the next level, so n batches leave at most
``FAN - 1`` runs per level and log(n) levels.  A version file per batch names
the runs that make up the table after it; it appears at once, by a rename.
Versions before the last two are removed with the runs that only they name, so
a reader that has just opened the version before finds its runs still there.

A repeated batch starts from the version before it and replaces its own run and
version.  What merging means is up to the table: it must not matter in which
order or how often rows are merged.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession

FAN = 8
_VERSIONS = "versions"


@dataclass(frozen=True)
class Run:
    name: str
    level: int


class RunTable:
    """Rows under ``root``; ``merge`` reduces rows of several runs to those that stand.

    Runs are sorted by ``order``, so that a filter on it skips most of their files and row groups.
    """

    def __init__(
        self, spark: SparkSession, root: str, merge: Callable[[DataFrame], DataFrame], order: Sequence[str] = (), fan: int = FAN
    ):
        self.spark, self.root, self.merge, self.order, self.fan = spark, root, merge, list(order), fan
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    # ---- versions

    def _at(self, *parts: str):
        return self._path("/".join((self.root, *parts)))

    def versions(self) -> list[int]:
        folder = self._at(_VERSIONS)
        if not self._files.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._files.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def _load(self, version: int) -> dict:
        stream = self._files.open(self._at(_VERSIONS, f"{version}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _store(self, version: int, content: dict) -> None:
        partial, target = self._at(_VERSIONS, f"{version}.tmp"), self._at(_VERSIONS, f"{version}.json")
        stream = self._files.create(partial, True)
        try:
            stream.write(bytearray(json.dumps(content).encode()))
        finally:
            stream.close()
        self._files.delete(target, False)
        self._files.rename(partial, target)

    def state(self, before: int | None = None) -> tuple[list[Run], dict]:
        """The runs of the newest version (older than ``before``) and what was noted with it."""
        known = [v for v in self.versions() if before is None or v < before]
        if not known:
            return [], {}
        content = self._load(known[-1])
        return [Run(*r) for r in content["runs"]], content["note"]

    # ---- rows

    def _rows(self, runs: list[Run]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.root}/{r.name}" for r in runs])

    def read(self, before: int | None = None, where: Column | None = None) -> DataFrame | None:
        """The rows that stand after the newest version (older than ``before``); None before the first batch.

        ``where`` chooses rows before they are merged, so it must hold for all rows of a key or for none.
        """
        runs, _ = self.state(before)
        if not runs:
            return None
        rows = self._rows(runs) if where is None else self._rows(runs).filter(where)
        return rows if len(runs) == 1 else self.merge(rows)

    def _write(self, rows: DataFrame, run: Run) -> None:
        merged = self.merge(rows)
        merged = merged.sort(*self.order) if self.order else merged
        merged.write.mode("overwrite").parquet(f"{self.root}/{run.name}")

    def add(self, rows: DataFrame, batch_id: int, note: dict | None = None) -> DataFrame:
        """Add a batch's rows, merged among themselves; returns those rows as written.  ``note`` goes with the version."""
        runs, _ = self.state(before=batch_id)
        own = Run(f"run-{batch_id}-0", 0)
        self._write(rows, own)
        written = self.spark.read.parquet(f"{self.root}/{own.name}")
        runs.append(own)
        while len(runs) >= self.fan and len({r.level for r in runs[-self.fan :]}) == 1:
            level = runs[-1].level + 1
            merged = Run(f"run-{batch_id}-{level}", level)
            self._write(self._rows(runs[-self.fan :]), merged)
            runs[-self.fan :] = [merged]
        self._store(batch_id, {"runs": [[r.name, r.level] for r in runs], "note": note or {}})
        self._clean(batch_id, {own.name})
        return written

    def _clean(self, batch_id: int, used: set[str]) -> None:
        known = self.versions()
        kept = [v for v in known if v <= batch_id][-2:]
        for v in kept:
            used |= {name for name, _ in self._load(v)["runs"]}
        for v in set(known) - set(kept):
            self._files.delete(self._at(_VERSIONS, f"{v}.json"), False)
        for f in self._files.listStatus(self._path(self.root)):
            name = f.getPath().getName()
            if name.startswith("run-") and name not in used:
                self._files.delete(f.getPath(), True)
