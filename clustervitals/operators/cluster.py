"""State of the segment instances.

``conf`` is the segment configuration: content (-1 = coordinator), role,
preferred_role, status, mode, hostname.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _flagged(conf: DataFrame, condition: Column) -> DataFrame:
    """Number of instances in a state, and the 0/1 result of the check."""
    return conf.agg(F.count_if(condition).alias("n")).withColumn("result", (F.col("n") > 0).cast("int"))


def segments_down(conf: DataFrame) -> DataFrame:
    return _flagged(conf, F.col("status") == "d")


def segments_out_of_sync(conf: DataFrame) -> DataFrame:
    return _flagged(conf, (F.col("mode") != "s") & (F.col("content") >= 0))


def role_switched(conf: DataFrame) -> DataFrame:
    return _flagged(conf, F.col("preferred_role") != F.col("role"))


def cluster_shape(conf: DataFrame, role_column: str = "preferred_role") -> DataFrame:
    """Segment hosts and primary segments; ``role_column`` may be the current ``role``."""
    segments = conf.filter(F.col("content") > -1)
    return segments.agg(
        F.count_distinct("hostname").alias("segment_hosts"),
        F.count_if(F.col(role_column) == "p").alias("primary_segments"),
    )


def host_lists(conf: DataFrame) -> DataFrame:
    """Distinct hosts: all, of the coordinator, of the segments."""
    kind = F.when(F.col("content") == -1, "coordinator").otherwise("segment")
    lists = F.explode(F.array(F.lit("all"), kind)).alias("list")
    return conf.select(lists, "hostname").distinct().orderBy("list", "hostname")


def recent_config_changes(history: DataFrame, n: int = 50, time: str = "ctime") -> DataFrame:
    """The latest n events."""
    others = [c for c in history.columns if c != time]
    return history.orderBy(F.desc(time), *others).limit(n)
