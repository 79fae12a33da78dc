"""Which tables are unevenly spread over the segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..sources.workspace import keep
from .scope import schema_scope
from .size import relation_files, with_root
from .spread import lookup_join

GIB = 1 << 30


def _key_columns(policy: DataFrame, attributes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Key columns of the tables that have a key: reloid, tablename, dk (and the columns ``by``)."""
    positions = (
        policy.select(*by, "reloid", "tablename", F.posexplode("distkey").alias("pos", "attnum"))
        .withColumn("attnum", F.col("attnum").cast("int"))
        .distinct()
    )
    # Few tables: their positions are broadcast and the attributes stay where they are.
    named = lookup_join(
        attributes.select(*by, "reloid", F.col("attnum").cast("int").alias("attnum"), "attname"),
        positions, [*by, "reloid", "attnum"], splits=1,
    )
    ordered = F.array_sort(F.collect_set(F.struct("pos", "attname")))
    return (
        named.groupBy(*by, "reloid", "tablename")
        .agg(ordered.alias("columns"))
        .select(*by, "reloid", "tablename", F.array_join("columns.attname", ",").alias("dk"))
    )


def distribution_key(policy: DataFrame, attributes: DataFrame) -> DataFrame:
    """Comma-joined key columns in key order per table; null when rows are spread randomly.

    ``policy``: reloid, tablename, distkey (array of attribute numbers).
    ``attributes``: reloid, attnum, attname.
    """
    keys = _key_columns(policy, attributes).select("reloid", "dk")
    return policy.select("reloid", "tablename").join(keys, "reloid", "left")


def skew_check(
    sizes: DataFrame,
    n_segments: int,
    min_total: int = GIB,
    threshold: float = 0.5,
    policy: DataFrame | None = None,
    attributes: DataFrame | None = None,
    parents: DataFrame | None = None,
    ordered: bool = True,
    by: Sequence[str] = (),
) -> DataFrame:
    """Large tables missing from some segments, or much heavier on one.

    Skew is (max - avg) / avg over the segments that hold data, so a table on
    one segment has skew 0 and is reported for its segment count.  One pass:
    bytes per (root table, segment), then all figures of a table at once.
    Leaves are rolled up by name, or by ``parents`` (see ``size.with_root``);
    rows of the coordinator (segid -1) do not count.  Tables of several
    databases or snapshots are told apart by the columns ``by``, which all
    inputs have then.

    With ``policy`` and ``attributes`` (see ``distribution_key``) the report
    names the distribution key.  The flagged tables are then kept in a
    checkpoint, and only their keys are looked up.
    """
    per_segment = (
        with_root(sizes.filter((F.col("relstorage") != "x") & (F.col("segid") >= 0)), parents, by)
        .groupBy(*by, F.col("root").alias("tablename"), "segid")
        .agg(F.sum("size_bytes").alias("bytes"))
        .filter(F.col("bytes") > 0)
    )
    # Bytes first, then the lowest segment, as one exact number: unlike a struct
    # it keeps the aggregation hashed, without sorting every segment's row.
    rank = F.col("bytes").cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(10,0)") - F.col("segid")
    per_table = (
        per_segment.groupBy(*by, "tablename")
        .agg(
            F.count("*").cast("int").alias("data_segcount"),
            F.sum("bytes").alias("total"),
            F.max("bytes").alias("top_bytes"),
            F.max_by("segid", rank).alias("top_segid"),
        )
        .filter(F.col("total") > min_total)
    )
    # max*n - total over total is (max - avg) / avg without a rounded average.
    total = F.col("total").cast("decimal(20,0)")
    excess = F.col("top_bytes").cast("decimal(20,0)") * F.col("data_segcount") - total
    flagged = per_table.withColumn("excess", excess).filter(
        (F.col("data_segcount") < n_segments)
        | (F.col("excess") > F.lit(str(threshold)).cast("decimal(9,4)") * total)
    )
    report = flagged.select(
        *by,
        "tablename",
        F.lit(n_segments).alias("sys_segcount"),
        "data_segcount",
        F.col("top_segid").alias("maxsize_segid"),
        F.col("top_bytes").alias("maxsize_bytes"),
        names.pretty_size(F.col("top_bytes")).alias("maxsize"),
        F.round(F.col("excess") / total, 2).cast("decimal(18,2)").alias("skew"),
    )
    if policy is None:
        report = report.withColumn("dk", F.lit(None).cast("string"))
    else:
        report = keep(report)
        roots = policy.filter(~names.is_leaf_name(F.col("tablename")))
        table = [*by, "tablename"]
        own = lookup_join(roots, report.select(*table), table, "left_semi", splits=1)
        keys = _key_columns(own, attributes, by).select(*table, "dk")
        report = report.join(keys, table, "left")
    return report.orderBy(*by, "data_segcount", F.desc("maxsize_bytes"), "tablename") if ordered else report


def skew_report(sizes: DataFrame, n_segments: int, ordered: bool = True, **options) -> DataFrame:
    """``skew_check`` over every user schema in one job, by table and falling skew."""
    report = skew_check(schema_scope(sizes, all_schemas=True), n_segments, ordered=False, **options)
    return report.orderBy(*options.get("by", ()), "tablename", F.desc("skew")) if ordered else report


def skew_from_files(files: DataFrame, rels: DataFrame, n_segments: int, **options) -> DataFrame:
    """``skew_check`` of heap tables, fed by the data files found on the segments."""
    heap = schema_scope(rels.filter(F.col("relstorage") == "h"), all_schemas=True)
    return skew_check(relation_files(files, heap), n_segments, **options)


def session_process_skew(procs: DataFrame, n: int | None = None) -> DataFrame:
    """Most processes any segment runs for each session, largest first."""
    busiest = (
        procs.groupBy("segid", "sessionid")
        .agg(F.count("*").alias("sess_proc_count"))
        .groupBy("sessionid")
        .agg(F.max("sess_proc_count").alias("sess_proc_count"))
        .orderBy(F.desc("sess_proc_count"), "sessionid")
    )
    return busiest if n is None else busiest.limit(n)


def data_key_skew(df: DataFrame, shard: Column, n_shards: int) -> DataFrame:
    """How unevenly rows fall on ``n_shards`` under a shard expression, e.g. a hash of a candidate key."""
    rows = df.groupBy(shard.alias("shard")).agg(F.count("*").alias("rows"))
    return rows.agg(
        F.lit(n_shards).alias("n_shards"),
        F.count("*").alias("data_shards"),
        F.coalesce(F.max("rows"), F.lit(0)).alias("max_rows"),
        F.try_divide(F.max("rows") * F.count("*") - F.sum("rows"), F.sum("rows")).alias("skew"),
    )
