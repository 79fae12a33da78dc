"""Landed files: data file inventories, listings, logs and process lists."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from datetime import datetime
from itertools import islice

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .workspace import keep, location_resolver

PROCESS_SCHEMA = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in ("hostname", "port", "username", "dbname", "masterip", "sessionid", "segid", "slicex")
    ]
)

# The summary line of a listing, by language.
LISTING_TOTALS = ("total", "总用量")


_ENTRY = "path string, is_dir boolean, size_bytes long, modtime timestamp"


def _list_entries() -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The entries of each directory."""
    resolve = location_resolver()

    def entries(path: str) -> Iterator[dict]:
        system, inner = resolve(path)
        prefix = path[: path.index("://") + 3] if "://" in path else ""
        for info in system.get_file_info(fs.FileSelector(inner)):
            yield {
                "path": prefix + info.path,
                "is_dir": info.type == fs.FileType.Directory,
                "size_bytes": info.size or 0,
                "modtime": info.mtime,
            }

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for directory in batch["path"]:
                listed = entries(directory)
                while chunk := list(islice(listed, 10_000)):
                    yield pd.DataFrame(chunk)

    return run


def file_inventory(
    spark: SparkSession,
    paths: str | Sequence[str],
    host_pattern: str = r"/host=([^/]+)/",
    segment_pattern: str = r"/(?:segid=|gpseg)(-?\d+)/",
    tasks: int | None = None,
) -> DataFrame:
    """One row per file: path, name, size, change time, and host and segment named by its path.

    Directories are listed by tasks, level by level until none is left; the
    directories of a level are spread over the cluster.  Empty files are
    included, which the built-in file sources leave out, and no listing is held
    by the driver.
    """
    # A fixed number of tasks: adaptive execution would merge these small rows into one.
    n = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    roots = [paths] if isinstance(paths, str) else list(paths)
    level = spark.createDataFrame([(root.rstrip("/"), True, 0, None) for root in roots], _ENTRY)
    found = level.filter(~F.col("is_dir"))
    while not (directories := level.filter("is_dir")).isEmpty():
        level = keep(directories.repartition(n, "path").mapInPandas(_list_entries(), _ENTRY))
        found = found.unionByName(level.filter(~F.col("is_dir")))
    path = F.col("path")
    host = F.nullif(F.regexp_extract(path, host_pattern, 1), F.lit(""))
    segment = F.nullif(F.regexp_extract(path, segment_pattern, 1), F.lit("")).try_cast("int")
    return found.select(
        "path",
        F.substring_index("path", "/", -1).alias("filename"),
        "size_bytes",
        "modtime",
        host.alias("hostname"),
        segment.alias("segid"),
    )


def _listing_fields(lines: DataFrame) -> DataFrame:
    """Listing lines that describe a file, split on runs of blanks."""
    line = F.col("line")
    noise = line.contains("?") | line.startswith("/") | (F.trim(line) == "")
    for word in LISTING_TOTALS:
        noise = noise | line.startswith(word)
    fields = F.split(line, " +")
    return (
        lines.filter(~noise)
        .withColumn("n_fields", F.size(fields))
        .select(
            "*",
            F.get(fields, F.lit(0)).alias("acl"),
            F.get(fields, F.lit(1)).try_cast("int").alias("num"),
            F.get(fields, F.lit(2)).alias("sysuser"),
            F.get(fields, F.lit(3)).alias("sysgroup"),
            F.get(fields, F.lit(4)).try_cast("decimal(38,0)").alias("size"),
            F.try_to_timestamp(F.get(fields, F.lit(5)), F.lit("yyyy-MM-dd_HH:mm:ss")).cast("timestamp_ntz").alias("modtime"),
            F.get(fields, F.lit(6)).alias("filename"),
        )
    )


def _well_formed() -> Column:
    return (
        (F.col("n_fields") == 7) & F.col("num").isNotNull() & F.col("size").isNotNull() & F.col("modtime").isNotNull()
    )


def parse_file_listing(lines: DataFrame) -> DataFrame:
    """The seven columns of a long file listing (column ``line``).

    Unreadable entries, directory headings, totals and blank lines are noise;
    anything else that does not parse is in ``listing_rejects``.
    """
    return _listing_fields(lines).filter(_well_formed()).drop("line", "n_fields")


def listing_rejects(lines: DataFrame) -> DataFrame:
    """Lines that look like a file entry but have a wrong shape."""
    return _listing_fields(lines).filter(~_well_formed()).select(*lines.columns)


def rejects_over_limit(lines: DataFrame, limit: int = 10) -> DataFrame:
    """Segments whose listing has ``limit`` rejected lines or more, so that their load would fail.

    ``lines`` carries ``segid`` beside ``line``.
    """
    counts = listing_rejects(lines).groupBy("segid").agg(F.count("*").alias("rejects"))
    return counts.filter(F.col("rejects") >= limit)


def log_lines(spark: SparkSession, root: str, date_prefix: str, name_prefix: str = "gpdb-") -> DataFrame:
    """Log lines of the files of one day or month, as ``host:file:record``.

    Files are ``<root>/**/<name_prefix><date>*.csv`` with the host as the first
    directory below ``root``; other days' files are never opened.  A file that is
    not below it, which a link can cause, has no host.
    """
    _check_prefix(date_prefix)
    text = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", f"{name_prefix}{date_prefix}*.csv")
        .text(root)
    )
    # Both paths without scheme and authority, and with their blanks and signs as they are on disk.
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(root)
    qualified = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop)
    inner = qualified.toUri().getPath().rstrip("/") + "/"
    encoded = F.regexp_extract(F.col("_metadata.file_path"), r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?(/.*)$", 1)
    path = F.url_decode(F.replace(encoded, F.lit("+"), F.lit("%2B")))
    below = F.when(F.startswith(path, F.lit(inner)), F.substr(path, F.lit(len(inner) + 1)))
    host = F.substring_index(below, "/", 1)
    file = F.coalesce(F.substr(below, F.length(host) + 1), path)
    return text.select(F.concat(F.coalesce(host, F.lit("")), F.lit(":"), file, F.lit(":"), F.col("value")).alias("log_msg"))


def _landed_log_lines(spark: SparkSession, root: str) -> DataFrame:
    schema = T.StructType(
        [T.StructField("log_msg", T.StringType()), T.StructField("dt", T.StringType()), T.StructField("host", T.StringType())]
    )
    return spark.read.schema(schema).text(root)


def partitioned_log_lines(spark: SparkSession, root: str, date_prefix: str) -> DataFrame:
    """Log lines landed under ``dt=YYYY-MM-DD/host=...`` for one day or month.

    The date filter prunes partitions.
    """
    _check_prefix(date_prefix)
    return _landed_log_lines(spark, root).filter(F.col("dt").startswith(date_prefix))


def log_lines_between(spark: SparkSession, root: str, since: datetime, until: datetime) -> DataFrame:
    """Log lines landed on every day from ``since`` to ``until``, for checks since the last one.

    Whole days are read; the checks compare the time of each line.
    """
    days = F.col("dt").between(f"{since:%Y-%m-%d}", f"{until:%Y-%m-%d}")
    return _landed_log_lines(spark, root).filter(days)


def _check_prefix(date_prefix: str) -> None:
    if len(date_prefix) not in (7, 10):
        raise ValueError("date must be YYYY-MM or YYYY-MM-DD")


def process_list(spark: SparkSession, path: str) -> DataFrame:
    """Server processes from blank-delimited rows."""
    return spark.read.csv(path, sep=" ", schema=PROCESS_SCHEMA)


def segment_union(coordinator: DataFrame, segments: DataFrame) -> DataFrame:
    """One catalog of the coordinator (segid -1) stacked on that of all segments."""
    return coordinator.withColumn("segid", F.lit(-1)).unionByName(segments)
