"""Which tables changed and which statistics are stale."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clock import before, instant
from .remediation import remediation_statements
from .scope import user_relations


def data_tables(rels: DataFrame, parts: DataFrame | None = None, first_oid: int = 16384) -> DataFrame:
    """User tables that hold rows themselves: no partition roots, no inner partition levels.

    ``parts``: schemaname, tablename, partitionlevel, partitiontablename.
    Without it the catalog decides: append-only relations with no children.
    """
    tables = user_relations(rels, first_oid).filter(F.col("relkind") == "r")
    if parts is None:
        return tables.filter(~F.col("relhassubclass") & F.col("relstorage").isin("a", "c"))
    deepest = parts.groupBy("schemaname", "tablename").agg(F.max("partitionlevel").alias("maxlevel"))
    inner = (
        parts.join(deepest, ["schemaname", "tablename"])
        .filter(F.col("partitionlevel") != F.col("maxlevel"))
        .select("schemaname", F.col("partitiontablename").alias("relname"))
    )
    roots = deepest.select("schemaname", F.col("tablename").alias("relname"))
    return tables.join(inner.unionByName(roots).distinct(), ["schemaname", "relname"], "left_anti")


def leaf_partitions(parts: DataFrame) -> DataFrame:
    """Partitions of the deepest level of each table."""
    deepest = parts.groupBy("schemaname", "tablename").agg(F.max("partitionlevel").alias("partitionlevel"))
    return parts.join(deepest, ["schemaname", "tablename", "partitionlevel"], "left_semi").distinct()


def mod_counts(aoseg: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """Change counter per table, summed over segment files.

    With ``tables`` (reloid) every listed table is reported, 0 when it has no
    segment file yet.
    """
    counts = aoseg.groupBy("reloid").agg(F.coalesce(F.sum("modcount"), F.lit(0)).alias("modcount"))
    if tables is None:
        return counts
    return (
        tables.select("reloid").distinct().join(counts, "reloid", "left")
        .withColumn("modcount", F.coalesce("modcount", F.lit(0)))
    )


def last_operation(ops: DataFrame, action: str = "ANALYZE", by: Sequence[str] = ()) -> DataFrame:
    """Time of the last operation of one kind per object; one row per object."""
    return (
        ops.filter(F.col("actionname") == action)
        .groupBy(*by, F.col("objid").alias("reloid"))
        .agg(F.max("statime").alias("last_time"))
    )


def changed_tables(
    state: DataFrame, current: DataFrame, ops: DataFrame | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Tables whose counter differs from the stored state, and tables not stored yet.

    ``state``: reloid, modcount, last_checktime.  ``current``: reloid,
    modcount.  Tables analyzed at or after their last check are left out when
    ``ops`` is given.  ``by`` names columns of all inputs that tell databases apart.
    """
    key = [*by, "reloid"]
    stored = state.groupBy(*key).agg(
        F.max_by("modcount", "last_checktime").alias("old_modcount"), F.max("last_checktime").alias("last_checktime")
    )
    known = F.col("last_checktime").isNotNull()
    moved = current.join(stored, key, "left").filter(~known | (F.col("modcount") != F.col("old_modcount")))
    if ops is not None:
        moved = moved.join(last_operation(ops, by=by), key, "left").filter(
            ~known | F.col("last_time").isNull() | (F.col("last_time") < F.col("last_checktime"))
        )
    return moved.select(*key, "modcount", F.when(known, "changed").otherwise("new").alias("reason"))


def stale_stats(rels: DataFrame, ops: DataFrame, as_of: datetime, max_age: timedelta = timedelta(days=3)) -> DataFrame:
    """Heap leaf tables never analyzed, or analyzed longer ago than ``max_age``."""
    heap = rels.filter((F.col("relkind") == "r") & (F.col("relstorage") == "h") & ~F.col("relhassubclass"))
    return (
        heap.select("reloid", "schemaname", "relname")
        .join(last_operation(ops), "reloid", "left")
        .filter(F.col("last_time").isNull() | (F.col("last_time") < before(as_of, max_age)))
        .withColumnRenamed("last_time", "last_analyze")
    )


def analyze_worklist(
    rels: DataFrame, ops: DataFrame, state: DataFrame, current: DataFrame, as_of: datetime,
    max_age: timedelta = timedelta(days=3),
) -> DataFrame:
    """Tables whose statistics are due, with their statement.

    Heap tables count by the age of their statistics, append-only tables by
    their change counters.
    """
    stale = stale_stats(rels, ops, as_of, max_age).select("reloid", "schemaname", "relname", F.lit("stale").alias("reason"))
    moved = changed_tables(state, current, ops).join(
        rels.filter(F.col("relstorage").isin("a", "c")).select("reloid", "schemaname", "relname"), "reloid"
    )
    both = stale.unionByName(moved.select("reloid", "schemaname", "relname", "reason"))
    return remediation_statements(both, "analyze")


def refresh_state(state: DataFrame, checked: DataFrame, live: DataFrame, as_of: datetime) -> DataFrame:
    """The next stored state: checked tables replaced, dropped tables removed.

    ``checked`` holds the tables whose analyze succeeded.  Write the result to
    a new snapshot; it reads the old one.
    """
    kept = (
        state.select("reloid", "modcount", "last_checktime")
        .join(checked.select("reloid"), "reloid", "left_anti")
        .join(live.select("reloid"), "reloid", "left_semi")
    )
    return kept.unionByName(checked.select("reloid", "modcount", instant(as_of).alias("last_checktime")))


def root_partitions(rels: DataFrame) -> DataFrame:
    """Partitioned parents, with the statement that collects their root statistics."""
    parents = rels.filter((F.col("relkind") == "r") & (F.col("relstorage") != "x") & F.col("relhassubclass"))
    return remediation_statements(parents.select("reloid", "schemaname", "relname"), "analyze_root")

