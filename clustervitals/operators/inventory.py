"""What the catalog holds: object counts, storage kinds, partitions, settings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names
from .remediation import remediation_statements
from .scope import not_system
from .spread import lookup_join, top_n


def object_counts(rels: DataFrame, attributes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Number of tables, views, partitions, schemas, relations and attributes."""
    counted = rels.groupBy(*by).agg(
        F.count_if(F.col("relkind") == "r").alias("tables"),
        F.count_if(F.col("relkind") == "v").alias("views"),
        F.count_if(F.col("relispartition")).alias("partitions"),
        F.count_distinct("schemaname").alias("namespaces"),
        F.count("*").alias("relations"),
    )
    kinds = ["tables", "views", "partitions", "namespaces", "relations"]
    return counted.unpivot(list(by), kinds, "object", "n").unionByName(
        attributes.groupBy(*by).agg(F.count("*").alias("n")).select(*by, F.lit("attributes").alias("object"), "n")
    )


def _labelled_tables(rels: DataFrame) -> DataFrame:
    """User tables with a storage label, from storage codes or from access methods.

    With an ``amname`` column, tables and partitioned tables are labelled by
    access method and foreign tables are counted too.
    """
    users = rels.filter(not_system(F.col("schemaname")))
    if "amname" in rels.columns:
        label = names.access_method_label(F.col("relkind"), F.col("amname"))
        return users.filter(F.col("relkind").isin("r", "p", "f")).withColumn("tabletype", label).filter(
            F.col("tabletype").isNotNull()
        )
    return users.filter(F.col("relkind") == "r").withColumn("tabletype", names.storage_label(F.col("relstorage")))


def storage_by_schema(rels: DataFrame, ordered: bool = True, by: Sequence[str] = ()) -> DataFrame:
    counts = _labelled_tables(rels).groupBy(*by, "schemaname", "tabletype").agg(F.count("*").alias("n"))
    return counts.orderBy(*by, "schemaname", "tabletype") if ordered else counts


def storage_totals(rels: DataFrame, ordered: bool = True, by: Sequence[str] = ()) -> DataFrame:
    counts = _labelled_tables(rels).groupBy(*by, "tabletype").agg(F.count("*").alias("n"))
    return counts.orderBy(*by, "tabletype") if ordered else counts


_PARTITION = ["schemaname", "tablename", "partitionschemaname", "partitiontablename"]


def subpartition_counts(parts: DataFrame, n: int | None = 100, by: Sequence[str] = ()) -> DataFrame:
    """Leaves per partitioned table, most first."""
    order = [F.desc("sub_count"), F.col("tablename")]
    counts = (
        parts.select(*by, *_PARTITION)
        .distinct()
        .groupBy(*by, names.qualified_name(F.col("schemaname"), F.col("tablename")).alias("tablename"))
        .agg(F.count("*").alias("sub_count"))
    )
    return counts.orderBy(*by, *order) if n is None else top_n(counts, order, n, by)


def partition_schema_mismatch(parts: DataFrame, ordered: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """Leaves stored in another schema than their parent."""
    strays = (
        parts.filter(F.col("schemaname") != F.col("partitionschemaname"))
        .select(
            *by,
            names.qualified_name(F.col("schemaname"), F.col("tablename")).alias("tablename"),
            names.qualified_name(F.col("partitionschemaname"), F.col("partitiontablename")).alias("partitiontablename"),
        )
        .distinct()
    )
    return strays.orderBy(*by, "tablename", "partitiontablename") if ordered else strays


def default_partition_rows(rows: DataFrame, ordered: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """Rows that fell into default partitions, one grouped scan for all tables.

    ``rows``: one row per stored row, tagged partitionschemaname,
    partitiontablename, partitionisdefault.  Empty partitions have no row here
    and so do not appear.
    """
    leaf = names.qualified_name(F.col("partitionschemaname"), F.col("partitiontablename"))
    counts = (
        rows.filter(F.col("partitionisdefault")).groupBy(*by, leaf.alias("tablename")).agg(F.count("*").alias("row_count"))
    )
    return counts.orderBy(*by, F.desc("row_count"), "tablename") if ordered else counts


def operation_history(ops: DataFrame, objects: DataFrame, ordered: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """Operations logged on the given objects (reloid, relname), by name and time."""
    named = objects.select(*by, F.col("reloid").alias("objid"), F.col("relname").alias("objname")).distinct()
    history = lookup_join(ops, named, [*by, "objid"])
    return history.orderBy(*by, "objname", "statime", "actionname") if ordered else history


def settings_report(settings: DataFrame) -> DataFrame:
    """Settings of each database or role as one text; those without settings are left out."""
    return settings.filter(F.col("setconfig").isNotNull()).select(
        "name", F.array_join("setconfig", ",").alias("setting")
    )


def owner_settings(settings: DataFrame, databases: DataFrame, roles: DataFrame) -> DataFrame:
    """Settings kept in one table for databases (setrole = 0) and roles (setdatabase = 0).

    ``databases``: oid, datname.  ``roles``: oid, rolname.
    """

    def of(kind: str, rows: DataFrame, key: str, owners: DataFrame, name: str) -> DataFrame:
        named = owners.select(F.col("oid").alias(key), F.col(name).alias("name"))
        return settings_report(rows.join(named, key)).select(F.lit(kind).alias("kind"), "name", "setting")

    on_database = of("database", settings.filter(F.col("setrole") == 0), "setdatabase", databases, "datname")
    on_role = of("role", settings.filter(F.col("setdatabase") == 0), "setrole", roles, "rolname")
    return on_database.unionByName(on_role)


def maintenance_targets(rels: DataFrame, schema: str = "pg_catalog") -> DataFrame:
    """Plain tables of one schema with the statement that maintains each."""
    tables = rels.filter(
        (F.col("schemaname") == schema) & (F.col("relkind") == "r") & (F.col("relstorage") != "x")
    )
    return remediation_statements(tables.select("schemaname", "relname"), "vacuum_analyze")
