"""Building blocks that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.workspace import keep

SPLITS = 32

# Largest rank that Spark cuts off before a shuffle by default (spark.sql.optimizer.windowGroupLimitThreshold).
GROUP_LIMIT = 1000

# A key of more rows than this is shared by several tasks.
HOT_ROWS = 1_000_000

# Largest lookup sent to every executor, as the length of its rows in text.
BROADCAST_BYTES = 32 << 20


def _split_of_task(splits: int) -> Column:
    # One split per input task: stable when a task is retried, and identical
    # rows arriving in different tasks still spread.
    return F.pmod(F.spark_partition_id(), F.lit(splits))


def lookup_join(
    facts: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "inner", splits: int | None = None
) -> DataFrame:
    """Equi-join of a large fact side with a small or key-unique lookup side.

    ``how`` must keep the fact side: inner, left_semi or left_anti.  The lookup
    is computed once and measured.  Up to ``BROADCAST_BYTES`` it is broadcast
    and the facts are not shuffled at all.  Beyond that the rows of each key are
    counted; a key of more than ``HOT_ROWS`` is shared by a task for every so
    many rows and its lookup rows are repeated for them, all others meet in one
    place.  Give ``splits=1`` when no key of the facts can be hot.
    """
    lookup = keep(lookup)
    row_bytes = F.octet_length(F.to_json(F.struct("*")))
    if lookup.agg(F.coalesce(F.sum(row_bytes), F.lit(0))).first()[0] <= BROADCAST_BYTES:
        return facts.join(F.broadcast(lookup), list(on), how)
    if splits == 1:
        return facts.join(lookup, list(on), how)
    # There are fewer of these than rows / HOT_ROWS.
    counted = facts.groupBy(*on).agg(F.count("*").alias("_n")).filter(F.col("_n") > HOT_ROWS)
    hot = keep(counted.select(*on, F.ceil(F.col("_n") / HOT_ROWS).cast("int").alias("_splits")))
    split = F.coalesce(F.pmod(F.spark_partition_id(), F.col("_splits")), F.lit(0))
    left = facts.join(F.broadcast(hot), list(on), "left").withColumn("_split", split).drop("_splits")
    every = F.explode(F.sequence(F.lit(0), F.coalesce("_splits", F.lit(1)) - 1))
    right = lookup.join(F.broadcast(hot), list(on), "left").withColumn("_split", every).drop("_splits")
    return left.join(right, [*on, "_split"], how).drop("_split")


def last_n_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str, splits: int = SPLITS
) -> DataFrame:
    """Rows ranked 1..n per key by ``order``.

    Up to ``GROUP_LIMIT`` Spark itself ranks in every task before rows move.
    Beyond it rows are ranked first inside (key, split) and then over the
    survivors, so the final task of a hot key sees at most ``splits * n`` rows.
    """
    final = Window.partitionBy(*keys).orderBy(*order)
    if n > GROUP_LIMIT:
        first = Window.partitionBy(*keys, "_split").orderBy(*order)
        df = df.withColumn("_split", _split_of_task(splits)).withColumn("_first", F.row_number().over(first))
        df = df.filter(F.col("_first") <= n).drop("_split", "_first")
    return df.withColumn(rank, F.row_number().over(final)).filter(F.col(rank) <= n)


def top_n(df: DataFrame, order: Sequence[Column | str], n: int, by: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows in ``order``, of every group of ``by`` if that is given.

    Groups are cut to n rows in every task before rows move.
    """
    if not by:
        return df.orderBy(*order).limit(n)
    return last_n_per_key(df, by, order, n, "_place").drop("_place")


def running_total(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str, partitions: int | None = None
) -> DataFrame:
    """Cumulative sum of ``value`` per key in ``order``, without one task per key.

    Rows are range-partitioned on (keys, order), which cuts a hot key into as
    many slices as it needs.  A row's total is the total of the earlier slices
    of its key plus the running sum inside its slice.  Slice numbers must be
    the same for both, hence the checkpoint.  ``keys`` must not be null and
    (keys, order) should be close to unique.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sliced = keep(df.repartitionByRange(n, *keys, *order).withColumn("_slice", F.spark_partition_id()))
    by_slice = sliced.groupBy(*keys, "_slice").agg(F.sum(value).alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_slice.select(
        *keys, "_slice", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        sliced.withColumn("_inside", F.sum(value).over(inside))
        .join(offsets, [*keys, "_slice"])
        .withColumn(out, F.col("_offset") + F.col("_inside"))
        .drop("_slice", "_inside", "_offset")
    )
