"""Durable results of streaming queries.

Each micro-batch writes under its own number, so a batch that is repeated after
a failure replaces its own output and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def batch_dir(root: str, batch_id: int) -> str:
    return f"{root}/batch={batch_id}"


def run_updates(
    stream: DataFrame, out: str, checkpoint: str, trigger: dict | None = None, mode: str = "update"
) -> StreamingQuery:
    """Write every batch's new or changed rows to ``out/batch=<n>``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(batch_dir(out, batch_id))

    return run_batches(stream, write, checkpoint, trigger, mode)


def run_batches(
    stream: DataFrame,
    write: Callable[[DataFrame, int], None],
    checkpoint: str,
    trigger: dict | None = None,
    mode: str = "append",
) -> StreamingQuery:
    return (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(write)
        .start()
    )


def read_updates(spark: SparkSession, out: str, keys: Sequence[str]) -> DataFrame:
    """The current value of each key: its row in the latest batch that holds it."""
    updates = spark.read.parquet(out)
    values = [c for c in updates.columns if c not in (*keys, "batch")]
    newest = F.max_by(F.struct(*values), "batch")
    return updates.groupBy(*keys).agg(newest.alias("v")).select(*keys, "v.*")
