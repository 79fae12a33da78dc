"""Error classes counted as logs arrive."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import logline
from ..operators.logs import PATTERNS, pattern_match
from .runs import RunTable
from .sinks import batch_dir, run_batches


def stream_log_lines(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(path).withColumnRenamed("value", "log_msg")


def _matches(lines: DataFrame, coordinators: Sequence[str]) -> DataFrame:
    """(ts, hostname, pattern): a row for every class that a line matches."""
    line = F.col("log_msg")
    host = logline.hostname(line)
    classes = F.array_compact(
        F.array(*[F.when(pattern_match(line, host, name, coordinators), F.lit(name)) for name in PATTERNS])
    )
    return lines.select(
        logline.log_ts(line).cast("timestamp").alias("ts"), host.alias("hostname"), F.explode(classes).alias("pattern")
    ).filter(F.col("ts").isNotNull())


def _counted(matches: DataFrame, window: str) -> DataFrame:
    return (
        matches.groupBy(F.window("ts", window).alias("w"), "hostname", "pattern")
        .agg(F.count("*").alias("matches"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "hostname", "pattern", "matches")
    )


def log_alerts(
    lines: DataFrame,
    coordinators: Sequence[str] = (),
    window: str = "5 minutes",
    lateness: str = "10 minutes",
) -> DataFrame:
    """Matches per window, host and error class; works on streams and on tables.

    A line counts once for every class it matches.  Lines later than
    ``lateness`` behind the newest one are dropped by a stream; ``stream_log_alerts`` keeps and counts them.
    """
    return _counted(_matches(lines, coordinators).withWatermark("ts", lateness), window)


ON_TIME, LATE, UNPARSABLE = "on time", "late", "unparsable"
ACCOUNT = "batch long, lines long, on_time long, late long, unparsable long"


def _alerts(spark: SparkSession, out: str) -> RunTable:
    keys = ["window_start", "window_end", "hostname", "pattern"]
    return RunTable(
        spark, f"{out}/alerts", lambda rows: rows.groupBy(*keys).agg(F.sum("matches").alias("matches")), order=["window_start"]
    )


def _account(spark: SparkSession, out: str) -> RunTable:
    return RunTable(spark, f"{out}/account", lambda rows: rows.dropDuplicates(["batch"]))


def stream_log_alerts(
    lines: DataFrame,
    out: str,
    checkpoint: str,
    coordinators: Sequence[str] = (),
    window: str = "5 minutes",
    lateness: timedelta = timedelta(minutes=10),
    trigger: dict | None = None,
) -> StreamingQuery:
    """Matches per window, host and error class, with every line accounted for.

    A line is late when its window ended ``lateness`` or longer before the newest time of all earlier batches.
    Late lines and those without a time are not counted but laid aside as they are (``read_aside``); how many lines
    went where is observed while a batch is read (``read_account``), and on time + late + unparsable = lines.
    ``read_alerts`` gives the counts, on demand with the late lines.  A repeated batch replaces what it wrote.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        alerts = _alerts(spark, out)
        newest = alerts.state(before=batch_id)[1].get("newest_us")
        ts = logline.log_ts(F.col("log_msg")).cast("timestamp")
        judged = batch.select("log_msg", ts.alias("ts"))
        late = F.lit(False)
        if newest is not None:
            limit = F.timestamp_micros(F.lit(newest - lateness // timedelta(microseconds=1)))
            # A window of a null time would leave the line out.
            some_time = F.coalesce("ts", F.timestamp_micros(F.lit(0)))
            late = F.window(some_time, window)["end"] <= limit
        kind = F.when(F.col("ts").isNull(), UNPARSABLE).when(late, LATE).otherwise(ON_TIME)
        judged = judged.withColumn("kind", kind)
        seen = Observation(f"lines of batch {batch_id}")
        counted = judged.observe(
            seen, F.count("*").alias("lines"), F.count_if(F.col("kind") == ON_TIME).alias("on_time"),
            F.count_if(F.col("kind") == LATE).alias("late"), F.count_if(F.col("kind") == UNPARSABLE).alias("unparsable"),
            F.max(F.unix_micros("ts")).alias("newest_us"),
        )
        aside = counted.filter(F.col("kind") != ON_TIME).select("log_msg", "kind")
        aside.write.mode("overwrite").parquet(batch_dir(f"{out}/aside", batch_id))
        found = seen.get
        newest = max((t for t in (newest, found["newest_us"]) if t is not None), default=None)
        in_time = _matches(judged.filter(F.col("kind") == ON_TIME), coordinators)
        alerts.add(_counted(in_time, window), batch_id, {"newest_us": newest})
        row = (batch_id, *(found[c] for c in ("lines", "on_time", "late", "unparsable")))
        _account(spark, out).add(spark.createDataFrame([row], ACCOUNT), batch_id)

    return run_batches(lines, write, checkpoint, trigger)


def read_account(spark: SparkSession, out: str) -> DataFrame:
    """(batch, lines, on_time, late, unparsable) of every batch."""
    found = _account(spark, out).read()
    return spark.createDataFrame([], ACCOUNT) if found is None else found


def read_aside(spark: SparkSession, out: str) -> DataFrame:
    """(log_msg, kind): the late and the unparsable lines."""
    return spark.read.schema("log_msg string, kind string").parquet(f"{out}/aside").select("log_msg", "kind")


def read_alerts(
    spark: SparkSession, out: str, with_late: bool = False, coordinators: Sequence[str] = (), window: str = "5 minutes"
) -> DataFrame | None:
    """Matches per window, host and error class; ``with_late`` adds those of late lines.  None before the first batch."""
    table = _alerts(spark, out)
    found = table.read()
    if found is None or not with_late:
        return found
    late = read_aside(spark, out).filter(F.col("kind") == LATE)
    return table.merge(found.unionByName(_counted(_matches(late, coordinators), window)))
