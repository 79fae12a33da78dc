"""One health report over all landed telemetry."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import age, bloat, cluster, inventory, sessions, size, skew
from ..sources.workspace import keep


def size_rollup(sizes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sizes reduced to one row per relation and segment, kept for the sections that read them.

    The checkpoint is scanned once per section instead of the raw snapshot and
    survives the loss of executors.
    """
    per_segment = sizes.groupBy(*by, "schemaname", "relname", "relstorage", "spcname", "segid")
    return keep(
        per_segment.agg(F.sum("size_bytes").alias("size_bytes"), F.sum("relfilecount").alias("relfilecount"))
    )


# Sections whose rows name databases themselves.
_OF_THE_CLUSTER = ("database size", "database age", "segment age", "idle transactions", "long queries")
# Inputs that describe one database; the others describe the cluster.
OF_A_DATABASE = (
    "rels", "attributes", "catalog_sizes", "catalog_compact", "ops", "sizes", "indexes", "parts", "visimap", "col_stats", "relpages",
)


def _sections(
    inputs: dict[str, DataFrame], as_of: datetime, n_segments: int, n: int, by: Sequence[str]
) -> Iterator[tuple]:
    """(section, rows, key, value) in report order, for the inputs at hand."""
    if "conf" in inputs:
        conf = inputs["conf"]
        yield "segments down", cluster.segments_down(conf), F.lit("instances"), "n"
        yield "segments out of sync", cluster.segments_out_of_sync(conf), F.lit("instances"), "n"
        yield "roles switched", cluster.role_switched(conf), F.lit("instances"), "n"
        shape = cluster.cluster_shape(conf)
        yield "cluster", shape.unpivot([], shape.columns, "k", "v"), F.col("k"), "v"
    if "config_history" in inputs:
        changes = cluster.recent_config_changes(inputs["config_history"], n)
        yield "configuration changes", changes, F.col("ctime").cast("string"), "desc"
    if "databases" in inputs:
        yield "database size", size.database_size(inputs["databases"], ordered=False), F.col("datname"), "size_bytes"
    if "dbs" in inputs:
        yield "database age", age.database_age(inputs["dbs"], ordered=False), F.col("datname"), "age_int"
        pair = F.concat_ws("/", F.col("segid").cast("string"), F.col("datname"))
        yield "segment age", age.segment_age(inputs["dbs"], n), pair, "age_int"
    if "activity" in inputs:
        activity = inputs["activity"]
        pid = F.col("pid").cast("string")
        yield "idle transactions", sessions.long_idle_transactions(activity, as_of), pid, "usename"
        yield "long queries", sessions.long_queries(activity, as_of), pid, "query"
    if "rels" in inputs and "attributes" in inputs:
        yield "objects", inventory.object_counts(inputs["rels"], inputs["attributes"], by), F.col("object"), "n"
    if "catalog_sizes" in inputs and "catalog_compact" in inputs:
        catalogs = bloat.catalog_bloat(inputs["catalog_sizes"], inputs["catalog_compact"], ordered=False, by=by)
        yield "catalog bloat", catalogs, F.col("catalog"), "bloat"
    if "rels" in inputs:
        kind = F.concat_ws("/", "schemaname", "tabletype")
        yield "storage by schema", inventory.storage_by_schema(inputs["rels"], ordered=False, by=by), kind, "n"
        yield "storage", inventory.storage_totals(inputs["rels"], ordered=False, by=by), F.col("tabletype"), "n"
    if "ops" in inputs and "rels" in inputs:
        catalogs = inputs["rels"].filter(F.col("schemaname") == "pg_catalog")
        history = inventory.operation_history(inputs["ops"], catalogs, ordered=False, by=by)
        yield "catalog operations", history, F.concat_ws("/", "objname", "actionname"), "statime"
    if "sizes" in inputs:
        sizes = size_rollup(inputs["sizes"], by)
        yield "schema size", size.schema_size(sizes, ordered=False, by=by), F.col("schemaname"), "size_bytes"
        yield "tablespace size", size.tablespace_size(sizes, ordered=False, by=by), F.col("tsname"), "size_bytes"
        yield "tablespace files", size.tablespace_max_files(sizes, ordered=False, by=by), F.col("tsname"), "max_segfilenum"
        table = F.concat_ws("/", "tablename", "relstorage")
        yield "append-only tables", size.top_relations(sizes, size.APPEND_ONLY, n, by=by), table, "size_bytes"
        yield "heap tables", size.top_relations(sizes, size.HEAP, n, by=by), table, "size_bytes"
        root = F.concat_ws("/", "root_partition", "relstorage")
        yield "partitioned tables", size.top_partitioned(sizes, 2 * n, by=by), root, "size_bytes"
        yield "temporary tables", size.top_temp_relations(sizes, n, by), table, "size_bytes"
        if "indexes" in inputs:
            index = F.concat_ws("/", "schemaname", "indexname")
            yield "indexes", size.top_indexes(inputs["indexes"], sizes, n, by), index, "index_bytes"
        yield "skew", skew.skew_report(sizes, n_segments, ordered=False, by=by), F.col("tablename"), "skew"
    if "parts" in inputs:
        parts = inputs["parts"]
        yield "subpartitions", inventory.subpartition_counts(parts, by=by), F.col("tablename"), "sub_count"
        yield (
            "partitions in another schema",
            inventory.partition_schema_mismatch(parts, ordered=False, by=by),
            F.col("partitiontablename"),
            "tablename",
        )
        yield "default partitions", inventory.default_partition_rows(parts, ordered=False, by=by), F.col("tablename"), "row_count"
    if "visimap" in inputs and "col_stats" in inputs and "relpages" in inputs:
        heap = bloat.heap_bloat(inputs["col_stats"], inputs["relpages"], by=by)
        report = bloat.bloat_report(heap, bloat.ao_bloat(inputs["visimap"], by=by), ordered=False, by=by)
        yield "bloat", report, F.concat_ws("/", "tablename", "relstorage"), "bloat"
    if "settings" in inputs:
        yield "settings", inventory.settings_report(inputs["settings"]), F.col("name"), "setting"
    if "owner_settings" in inputs and "database_names" in inputs and "roles" in inputs:
        owned = inventory.owner_settings(inputs["owner_settings"], inputs["database_names"], inputs["roles"])
        yield "owner settings", owned, F.concat_ws("/", "kind", "name"), "setting"


def health_report(
    inputs: dict[str, DataFrame], as_of: datetime, n_segments: int, n: int = 50, by: Sequence[str] = ()
) -> DataFrame:
    """All checks in one table: section, ordinal (the section's place in the report), key, value.

    ``inputs`` may hold conf, config_history (ctime, desc), databases, dbs,
    activity, rels, attributes, catalog_sizes, catalog_compact, ops, sizes,
    indexes, parts, visimap, col_stats, relpages, settings (name, setconfig) and
    owner_settings with database_names and roles (see
    ``inventory.owner_settings``); sections without input are left out.

    ``by`` names the columns (datname, snapshot_ts) that tell several databases
    or snapshots apart in the inputs of ``OF_A_DATABASE``.  The report then has
    these columns, every figure and top list is of one of them, and they are
    null in sections about the cluster.
    """
    kinds = {c: inputs[name].schema[c].dataType for name in OF_A_DATABASE if name in inputs for c in by}

    def rows(at: int, section: str, df: DataFrame, key: Column, value: str) -> DataFrame:
        of = [F.col(c) if c in df.columns and section not in _OF_THE_CLUSTER else F.lit(None).cast(kinds[c]).alias(c) for c in by if c in kinds]
        return df.select(
            *of,
            F.lit(section).alias("section"),
            F.lit(at).alias("ordinal"),
            key.alias("key"),
            F.col(value).cast("string").alias("value"),
        )

    parts = [rows(at, *section) for at, section in enumerate(_sections(inputs, as_of, n_segments, n, by), start=1)]
    return reduce(DataFrame.unionByName, parts)
