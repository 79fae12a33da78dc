"""Where storage goes.

``sizes`` has one row per segment and relation: schemaname, relname, reloid,
segid, size_bytes, relfilecount, relstorage, spcname.  Names and numbers of
relations are unique in one database and snapshot only: ``by`` names the columns
(datname, snapshot_ts) that tell several apart, and figures and top lists are
then those of each.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..functions.clock import instant
from .spread import top_n

# Storage classes by code.
APPEND_ONLY = ("a", "c")
HEAP = ("h",)
LOCAL_STORAGE = ("a", "c", "h")

SYSTEM_DATABASES = ("postgres", "template1", "template0")


def relation_files(files: DataFrame, rels: DataFrame) -> DataFrame:
    """Bytes, file count and last change per relation (and host, segment and database, if given).

    ``files`` are data files; ``<node>.N`` are further parts of ``<node>``.
    Fork files (``_fsm``, ``_vm``) match no relation and drop out.  Node numbers
    are unique in one database of one segment only, so files meet the catalog on
    ``segid`` and ``datname`` too where both sides have them.
    """
    place = [c for c in ("hostname", "segid", "datname") if c in files.columns]
    per_node = (
        files.withColumn("relfilenode", F.split_part("filename", F.lit("."), F.lit(1)))
        .groupBy(*place, "relfilenode")
        .agg(
            F.sum("size_bytes").alias("size_bytes"),
            F.count("*").alias("relfilecount"),
            F.max("modtime").alias("max_modtime"),
        )
    )
    keyed = rels.withColumn("relfilenode", F.col("relfilenode").cast("string"))
    on = ["relfilenode", *(c for c in ("segid", "datname") if c in place and c in rels.columns)]
    return keyed.join(per_node, on).select(
        *place, *(c for c in rels.columns if c not in place), "size_bytes", "relfilecount", "max_modtime"
    )


def schema_size(sizes: DataFrame, ordered: bool = True, by: Sequence[str] = ()) -> DataFrame:
    totals = (
        sizes.filter(~F.col("schemaname").startswith("pg_temp"))
        .groupBy(*by, "schemaname")
        .agg(F.sum("size_bytes").alias("size_bytes"))
        .withColumn("size", names.pretty_size(F.col("size_bytes")))
    )
    return totals.orderBy(*by, F.desc("size_bytes"), "schemaname") if ordered else totals


def _tablespace(sizes: DataFrame) -> DataFrame:
    return sizes.withColumn("tsname", F.coalesce("spcname", F.lit("pg_default")))


def tablespace_size(
    sizes: DataFrame, by_size: bool = False, ordered: bool = True, by: Sequence[str] = ()
) -> DataFrame:
    order = [F.desc("size_bytes"), F.col("tsname")] if by_size else [F.col("tsname")]
    totals = (
        _tablespace(sizes)
        .groupBy(*by, "tsname")
        .agg(F.sum("size_bytes").alias("size_bytes"))
        .withColumn("size", names.pretty_size(F.col("size_bytes")))
    )
    return totals.orderBy(*by, *order) if ordered else totals


def tablespace_max_files(sizes: DataFrame, ordered: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """Files of the segment that holds most of them, per tablespace."""
    most = (
        _tablespace(sizes)
        .groupBy(*by, "tsname", "segid")
        .agg(F.sum("relfilecount").alias("files"))
        .groupBy(*by, "tsname")
        .agg(F.max("files").alias("max_segfilenum"))
    )
    return most.orderBy(*by, F.desc("max_segfilenum"), "tsname") if ordered else most


def _largest(
    sizes: DataFrame, n: int, key: str = "tablename", storage_column: str = "relstorage", by: Sequence[str] = ()
) -> DataFrame:
    totals = sizes.groupBy(*by, key, storage_column).agg(F.sum("size_bytes").alias("size_bytes"))
    top = top_n(totals, [F.desc("size_bytes"), F.col(key), F.col(storage_column)], n, by)
    return top.withColumn("size", names.pretty_size(F.col("size_bytes")))


def _with_tablename(sizes: DataFrame) -> DataFrame:
    return sizes.withColumn("tablename", names.qualified_name(F.col("schemaname"), F.col("relname")))


def with_root(sizes: DataFrame, parents: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Add ``root``, the table a relation's bytes count for, and ``is_leaf``.

    Leaves are known by their name, or by the catalog when ``parents`` (reloid,
    root_schema, root_name, and the columns ``by``) is given.
    """
    own = names.qualified_name(F.col("schemaname"), F.col("relname"))
    if parents is None:
        return sizes.withColumn("root", names.partition_root(own)).withColumn(
            "is_leaf", names.is_leaf_name(F.col("relname"))
        )
    roots = parents.select(*by, "reloid", names.qualified_name(F.col("root_schema"), F.col("root_name")).alias("_root"))
    return (
        sizes.join(roots, [*by, "reloid"], "left")
        .withColumn("root", F.coalesce(F.col("_root"), own))
        .withColumn("is_leaf", F.col("_root").isNotNull())
        .drop("_root")
    )


def top_relations(
    sizes: DataFrame, storage: Sequence[str] = APPEND_ONLY, n: int = 100, storage_column: str = "relstorage",
    by: Sequence[str] = (),
) -> DataFrame:
    """The n largest relations of the given storage classes (codes, or access methods in another column)."""
    return _largest(
        _with_tablename(sizes.filter(F.col(storage_column).isin(*storage))), n, storage_column=storage_column, by=by
    )


def top_partitioned(
    sizes: DataFrame, n: int = 100, parents: DataFrame | None = None, storage: Sequence[str] = LOCAL_STORAGE,
    by: Sequence[str] = (),
) -> DataFrame:
    """The n largest partitioned tables: bytes of the leaves summed to their root."""
    leaves = with_root(sizes.filter(F.col("relstorage").isin(*storage)), parents, by).filter(F.col("is_leaf"))
    return _largest(leaves.withColumnRenamed("root", "root_partition"), n, "root_partition", by=by)


def top_temp_relations(sizes: DataFrame, n: int = 50, by: Sequence[str] = ()) -> DataFrame:
    """The n largest temporary relations, by persistence when known, else by schema name."""
    temporary = (
        F.col("relpersistence") == "t"
        if "relpersistence" in sizes.columns
        else F.col("schemaname").startswith("pg_temp")
    )
    return _largest(_with_tablename(sizes.filter(temporary & F.col("relstorage").isin(*LOCAL_STORAGE))), n, by=by)


def top_indexes(indexes: DataFrame, sizes: DataFrame, n: int = 50, by: Sequence[str] = ()) -> DataFrame:
    """The n largest indexes with the size of their table.

    Indexes are cut to n first, so only sizes of those tables are summed.
    """
    order = [F.desc("index_bytes"), F.col("schemaname"), F.col("tablename"), F.col("indexname")]
    top, table = top_n(indexes, order, n, by), [*by, "schemaname", "tablename"]
    tables = (
        sizes.withColumnRenamed("relname", "tablename")
        .join(top.select(*table).distinct(), table, "left_semi")
        .groupBy(*table)
        .agg(F.sum("size_bytes").alias("table_bytes"))
    )
    return (
        top.join(tables, table, "left")
        .withColumn("index_size", names.pretty_size(F.col("index_bytes")))
        .withColumn("table_size", names.pretty_size(F.col("table_bytes")))
        .orderBy(*by, *order)
    )


def partition_table_size(sizes: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """Bytes of all leaves per partitioned table.

    With ``tables`` (schemaname, relname) every listed table is reported, null
    when it has no leaves.
    """
    leaves = sizes.filter(names.is_leaf_name(F.col("relname")))
    per_root = (
        leaves.withColumn("relname", names.partition_root(F.col("relname")))
        .groupBy("schemaname", "relname")
        .agg(F.sum("size_bytes").alias("size_bytes"))
    )
    if tables is None:
        return per_root
    return tables.select("schemaname", "relname").distinct().join(per_root, ["schemaname", "relname"], "left")


def database_size(sizes: DataFrame, ordered: bool = True) -> DataFrame:
    """Bytes per database; ``sizes`` has datname and size_bytes."""
    totals = (
        sizes.filter(~F.col("datname").isin(*SYSTEM_DATABASES))
        .groupBy("datname")
        .agg(F.sum("size_bytes").alias("size_bytes"))
        .withColumn("size", names.pretty_size(F.col("size_bytes")))
    )
    return totals.orderBy(F.desc("size_bytes"), "datname") if ordered else totals


def retention_plan(files: DataFrame, as_of: datetime, rm_days: int = 30, gzip_days: int = 5) -> DataFrame:
    """What to do with each log file: delete, compress or keep.

    Age counts whole days and must exceed the limit.  Deleting covers rotated
    and compressed names too, compressing only plain ``.log`` / ``.csv``.
    """
    name = F.col("filename")
    age = F.floor(F.timestamp_diff("SECOND", "modtime", instant(as_of)) / 86400)
    deletable = name.contains(".log") | name.contains(".csv")
    compressible = name.endswith(".log") | name.endswith(".csv")
    return files.withColumn("age_days", age).withColumn(
        "action",
        F.when(deletable & (F.col("age_days") > rm_days), "delete")
        .when(compressible & (F.col("age_days") > gzip_days), "compress")
        .otherwise("keep"),
    )
