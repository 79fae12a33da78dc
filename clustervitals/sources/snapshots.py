"""Tables kept as numbered snapshots.

A new state may be computed from the old one, so it is written beside it as
``<root>/version=<n>``; readers take the newest version that is complete.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .workspace import location_resolver


def last_version(root: str) -> int | None:
    """Number of the newest complete snapshot, or None."""
    from pyarrow import fs

    system, inner = location_resolver()(root)
    entries = system.get_file_info(fs.FileSelector(inner, allow_not_found=True))
    numbers = [int(e.base_name.split("=", 1)[1]) for e in entries if e.base_name.startswith("version=")]
    complete = [
        n for n in numbers if system.get_file_info(f"{inner}/version={n}/_SUCCESS").type == fs.FileType.File
    ]
    return max(complete, default=None)


def write_snapshot(df: DataFrame, root: str) -> int:
    """Write the next version and return its number; an incomplete one is replaced."""
    last = last_version(root)
    version = 0 if last is None else last + 1
    df.write.mode("overwrite").parquet(f"{root}/version={version}")
    return version


def read_snapshot(spark: SparkSession, root: str) -> DataFrame:
    last = last_version(root)
    if last is None:
        raise FileNotFoundError(f"no complete snapshot under {root}")
    return spark.read.parquet(f"{root}/version={last}")
