"""Every operator as a named query over the fixtures of one data directory."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import acl, names
from ..operators import (
    age, bloat, change, cluster, inventory, locks, logs, monitor, privileges, scope, sessions, size, skew,
)
from ..operators.remediation import remediation_statements
from ..sources import files, sinks, snapshots
from ..sources.workspace import fresh_dir, location_resolver
from ..streaming import changes as stream_changes
from ..streaming import log_alerts as stream_logs
from ..streaming import metrics as stream_metrics
from ..streaming import sessions as stream_sessions
from ..streaming import sinks as stream_sinks
from .fixtures import DATABASES, Fixtures, database_rows
from .metrics import metric_results as collect_metrics
from .report import health_report

AS_OF = datetime(2024, 1, 31)
N_SEGMENTS = 8
LOG_SINCE = datetime(2024, 1, 1)
OPS_AS_OF = datetime(2001, 8, 1)
STATE_TIME = datetime(2000, 1, 1)

Build = Callable[[Fixtures], DataFrame]
BUILDS: dict[str, Build] = {}


def query(build: Build) -> Build:
    BUILDS[build.__name__] = build
    return build


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles and zoned timestamps as zone-free ones, for comparison."""
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            column = column.cast("double").alias(field.name)
        elif isinstance(field.dataType, T.TimestampType):
            column = column.cast("timestamp_ntz").alias(field.name)
        columns.append(column)
    return df.select(*columns)


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return plain(BUILDS[name](Fixtures(spark, sf_dir)))


# ---- sources and sinks


@query
def file_inventory(fx):
    # A file per metric, in folders of different depth.
    root = fresh_dir(fx.spark, "files with blanks")
    for folder in ("host=h1/data/gpseg0/base", "host=h1/gpseg1", "host=h2"):
        sinks.export_metric_text(fx.fx_history, f"{root}/{folder}")
    return files.file_inventory(fx.spark, root).select("filename", "size_bytes", "hostname", "segid")


@query
def parse_file_listing(fx):
    return files.parse_file_listing(fx.fx_listing)


@query
def listing_rejects(fx):
    return files.listing_rejects(fx.fx_listing)


@query
def rejects_over_limit(fx):
    return files.rejects_over_limit(fx.fx_seg_listing, 2)


def _landed_logs(fx):
    root = fresh_dir(fx.spark, "log")
    line = F.col("log_msg")
    landed = fx.fx_log.select(
        line,
        F.substring(F.split_part(line, F.lit(".csv:"), F.lit(2)), 1, 10).alias("dt"),
        F.split_part(line, F.lit(":"), F.lit(1)).alias("host"),
    )
    landed.hint("rebalance", "dt", "host").write.partitionBy("dt", "host").text(root)
    return root


@query
def partitioned_log_lines(fx):
    return files.partitioned_log_lines(fx.spark, _landed_logs(fx), "2024-01")


def _log_files(fx):
    """The lines as files below a folder for each host, in a root with a blank and a sign."""
    root = f"{fresh_dir(fx.spark, 'my logs+more')}/my logs+more"
    line = F.col("log_msg")
    host, file = F.substring_index(line, ":", 1), F.substring_index(F.substring_index(line, ":", 2), ":", -1)
    record = F.substr(line, F.length(host) + F.length(file) + 3)
    by_file = fx.fx_log.groupBy(host.alias("host"), file.alias("file")).agg(F.array_join(F.collect_list(record), "\n").alias("text"))
    resolve = location_resolver()

    def write(rows):
        system, inner = resolve(root)
        for row in rows:
            target = f"{inner}/{row.host}{row.file}"
            system.create_dir(target.rsplit("/", 1)[0], recursive=True)
            with system.open_output_stream(target) as out:
                out.write(row.text.encode())

    by_file.foreachPartition(write)
    return root


@query
def log_lines(fx):
    return files.log_lines(fx.spark, _log_files(fx), "2024-01")


@query
def log_lines_between(fx):
    return files.log_lines_between(fx.spark, _landed_logs(fx), datetime(2024, 1, 12, 8), AS_OF)


@query
def process_list(fx):
    path = fresh_dir(fx.spark, "processes")
    fx.fx_proc_lines.write.text(path)
    return files.process_list(fx.spark, path)


@query
def segment_union(fx):
    ages = fx.fx_rel_age
    coordinator = ages.filter("segid = -1").drop("segid")
    return files.segment_union(coordinator, ages.filter("segid >= 0"))


@query
def save_report(fx):
    path = fresh_dir(fx.spark, "report")
    sinks.save_report(size.schema_size(fx.fx_rel_size), path)
    return fx.spark.read.parquet(path)


@query
def append_history(fx):
    path = fresh_dir(fx.spark, "history")
    sinks.append_history(fx.fx_history, path)
    return fx.spark.read.parquet(path).withColumn("dt", F.col("dt").cast("string"))


@query
def export_metric_text(fx):
    path = fresh_dir(fx.spark, "metrics")
    sinks.export_metric_text(fx.fx_history, path)
    return sinks.read_metric_text(fx.spark, path)


@query
def remediation_reorganize(fx):
    return remediation_statements(bloat_report(fx), "reorganize").select("tablename", "statement")


@query
def remediation_freeze(fx):
    return remediation_statements(high_age_relations(fx), "freeze").select("reloid", "statement")


@query
def remediation_analyze(fx):
    return remediation_statements(stale_stats(fx), "analyze").select("reloid", "statement")


@query
def remediation_drop_schema(fx):
    return remediation_statements(orphan_temp_schemas(fx), "drop_schema").select("nspname", "statement")


@query
def remediation_terminate(fx):
    return remediation_statements(idle_session_candidates(fx), "terminate").select("pid", "statement")


# ---- scoping and projections


@query
def schema_scope_all(fx):
    return scope.schema_scope(fx.fx_rel, all_schemas=True).select("reloid", "schemaname")


@query
def schema_scope_include(fx):
    return scope.schema_scope(fx.fx_rel, include=["s1", "pg_catalog"]).select("reloid", "schemaname")


@query
def schema_scope_exclude(fx):
    return scope.schema_scope(fx.fx_rel, exclude=["s1", "s2"]).select("reloid", "schemaname")


@query
def analyze_scope(fx):
    return scope.analyze_scope(fx.fx_rel, ["s3"]).select("reloid", "schemaname")


@query
def user_relations(fx):
    return scope.user_relations(fx.fx_rel_user).select("reloid", "schemaname", "relname")


@query
def partition_root(fx):
    return fx.fx_rel.select("reloid", names.partition_root(F.col("relname")).alias("root"))


@query
def storage_label(fx):
    return fx.fx_rel.select("reloid", names.storage_label(F.col("relstorage")).alias("tabletype"))


@query
def pretty_size(fx):
    return fx.fx_rel_size.groupBy("schemaname", "relname", "segid").agg(F.sum("size_bytes").alias("size_bytes")).select(
        "schemaname", "relname", "segid", names.pretty_size(F.col("size_bytes")).alias("size")
    )


@query
def query_snippet(fx):
    return fx.documents.select("doc_id", names.query_snippet(F.col("text")).alias("snippet"))


# ---- size


@query
def relation_files(fx):
    return size.relation_files(fx.fx_files, fx.fx_relfilenode)


@query
def relation_files_by_segment(fx):
    found = size.relation_files(fx.fx_seg_files, fx.fx_seg_rels)
    return found.withColumn("max_modtime", F.col("max_modtime").cast("timestamp_ntz"))


@query
def schema_size(fx):
    return size.schema_size(fx.fx_temp_size)


@query
def tablespace_size(fx):
    return size.tablespace_size(fx.fx_rel_size)


@query
def tablespace_max_files(fx):
    return size.tablespace_max_files(fx.fx_rel_size)


@query
def top_append_only(fx):
    return size.top_relations(fx.fx_rel_size, size.APPEND_ONLY, 100)


@query
def top_heap(fx):
    return size.top_relations(fx.fx_rel_size, size.HEAP, 50)


@query
def top_partitioned(fx):
    return size.top_partitioned(fx.fx_rel_size)


@query
def top_partitioned_by_catalog(fx):
    return size.top_partitioned(fx.fx_leaf_size, 100, fx.fx_leaf_parent)


@query
def top_by_access_method(fx):
    method = F.when(F.col("relstorage") == "h", "heap").when(F.col("relstorage") == "c", "ao_column")
    return size.top_relations(fx.fx_rel_size.withColumn("amname", method), ["ao_row", "ao_column"], 50, "amname")


@query
def top_temp_relations(fx):
    return size.top_temp_relations(fx.fx_temp_size)


@query
def top_indexes(fx):
    return size.top_indexes(fx.fx_index, fx.fx_rel_size)


@query
def partition_table_size(fx):
    tables = fx.fx_rel_size.select("schemaname", names.partition_root(F.col("relname")).alias("relname"))
    return size.partition_table_size(fx.fx_rel_size, tables)


@query
def database_size(fx):
    return size.database_size(fx.fx_rel_size.withColumnRenamed("schemaname", "datname"))


@query
def retention_plan(fx):
    return size.retention_plan(fx.fx_log_files, AS_OF)


# ---- skew


@query
def skew_check(fx):
    return skew.skew_check(fx.fx_rel_size, N_SEGMENTS, policy=fx.fx_dk, attributes=fx.fx_attr)


@query
def skew_check_by_catalog(fx):
    return skew.skew_check(fx.fx_leaf_size, N_SEGMENTS, min_total=1 << 20, threshold=0.1, parents=fx.fx_leaf_parent)


@query
def distribution_key(fx):
    return skew.distribution_key(fx.fx_dk, fx.fx_attr)


@query
def skew_from_files(fx):
    return skew.skew_from_files(fx.fx_seg_files, fx.fx_seg_rels, N_SEGMENTS, min_total=1 << 20)


@query
def session_process_skew(fx):
    return skew.session_process_skew(fx.fx_proc)


@query
def session_process_skew_top(fx):
    return skew.session_process_skew(fx.fx_proc, 1)


@query
def data_key_skew(fx):
    return skew.data_key_skew(fx.lineitem, F.pmod(F.col("l_suppkey"), F.lit(N_SEGMENTS)), N_SEGMENTS)


@query
def skew_report(fx):
    return skew.skew_report(fx.fx_rel_size, N_SEGMENTS, min_total=1 << 20, threshold=0.02)


# ---- bloat


@query
def ao_bloat(fx):
    return bloat.ao_bloat(fx.fx_visimap)


def _heap_bloat(fx):
    return bloat.heap_bloat(fx.fx_colstats, fx.fx_relpages, min_wasted=1 << 20, min_bloat=1.0)


@query
def heap_bloat(fx):
    return _heap_bloat(fx)


@query
def bloat_report(fx):
    return bloat.bloat_report(_heap_bloat(fx), bloat.ao_bloat(fx.fx_visimap))


@query
def catalog_bloat(fx):
    return bloat.catalog_bloat(fx.fx_cat_seg, fx.fx_catsize)


# ---- catalog inventory


@query
def object_counts(fx):
    return inventory.object_counts(fx.fx_rel, fx.fx_attr)


@query
def storage_by_schema(fx):
    return inventory.storage_by_schema(fx.fx_rel)


@query
def storage_totals(fx):
    return inventory.storage_totals(fx.fx_rel)


@query
def storage_by_access_method(fx):
    method = F.when(F.col("relstorage") == "h", "heap").when(F.col("relstorage") == "c", "ao_column")
    return inventory.storage_by_schema(fx.fx_rel.withColumn("amname", method))


@query
def subpartition_counts(fx):
    return inventory.subpartition_counts(fx.fx_parts)


@query
def partition_schema_mismatch(fx):
    return inventory.partition_schema_mismatch(fx.fx_parts)


@query
def default_partition_rows(fx):
    return inventory.default_partition_rows(fx.fx_parts)


@query
def operation_history(fx):
    system = fx.fx_rel.filter(F.col("schemaname") == "pg_catalog")
    return inventory.operation_history(fx.fx_ops, system)


@query
def settings_report(fx):
    return inventory.settings_report(fx.fx_settings)


@query
def owner_settings(fx):
    owners = fx.supplier.select(F.col("s_suppkey").alias("oid"), F.col("s_name").alias("datname"), F.col("s_name").alias("rolname"))
    return inventory.owner_settings(fx.fx_owner_settings, owners, owners)


@query
def maintenance_targets(fx):
    return inventory.maintenance_targets(fx.fx_rel)


# ---- change detection


@query
def data_tables(fx):
    return change.data_tables(fx.fx_rel_user, fx.fx_partlevel).select("reloid", "schemaname", "relname")


@query
def data_tables_by_catalog(fx):
    return change.data_tables(fx.fx_rel_user).select("reloid", "schemaname", "relname")


@query
def leaf_partitions(fx):
    return change.leaf_partitions(fx.fx_partlevel)


@query
def mod_counts(fx):
    return change.mod_counts(fx.fx_aoseg, fx.fx_rel)


def _state(fx):
    return fx.fx_modcount_old.withColumn("last_checktime", F.lit(str(STATE_TIME)).cast("timestamp_ntz"))


@query
def changed_tables(fx):
    return change.changed_tables(_state(fx), fx.fx_modcount_new, fx.fx_ops)


@query
def changed_tables_before_analyze(fx):
    return change.changed_tables(_state(fx), fx.fx_modcount_new)


@query
def stale_stats(fx):
    return change.stale_stats(fx.fx_rel, fx.fx_ops, OPS_AS_OF)


@query
def analyze_worklist(fx):
    return change.analyze_worklist(fx.fx_rel, fx.fx_ops, _state(fx), fx.fx_modcount_new, OPS_AS_OF)


@query
def refresh_state(fx):
    done = change.changed_tables(_state(fx), fx.fx_modcount_new, fx.fx_ops)
    live = fx.fx_rel.filter(F.col("relkind") == "r")
    return change.refresh_state(_state(fx), done, live, OPS_AS_OF)


@query
def state_snapshot(fx):
    root = fresh_dir(fx.spark, "state")
    snapshots.write_snapshot(_state(fx), root)
    state = snapshots.read_snapshot(fx.spark, root)
    done = change.changed_tables(state, fx.fx_modcount_new, fx.fx_ops)
    live = fx.fx_rel.filter(F.col("relkind") == "r")
    snapshots.write_snapshot(change.refresh_state(state, done, live, OPS_AS_OF), root)
    return snapshots.read_snapshot(fx.spark, root)


@query
def root_partitions(fx):
    return change.root_partitions(fx.fx_rel)


# ---- wraparound age


@query
def database_age(fx):
    return age.database_age(fx.fx_db_age)


@query
def database_age_top(fx):
    return age.database_age(fx.fx_db_age, 1)


@query
def segment_age(fx):
    return age.segment_age(fx.fx_db_age)


@query
def high_age_relations(fx):
    return age.high_age_relations(fx.fx_rel_age, fx.fx_rel)


@query
def high_age_partitions(fx):
    return age.high_age_relations(fx.fx_rel_age, fx.fx_rel, leaves=True)


@query
def high_age_auxiliary(fx):
    return age.high_age_auxiliary(fx.fx_aux_age, fx.fx_aux_link, fx.fx_rel)


@query
def freeze_worklist(fx):
    return age.freeze_worklist(fx.fx_rel_age, fx.fx_aux_age, fx.fx_aux_link, fx.fx_rel)


@query
def high_age_databases(fx):
    return age.high_age_databases(fx.fx_db_age, ["db0", "db1", "db2"])


# ---- sessions and locks


@query
def active_sql(fx):
    return sessions.active_sql(fx.fx_activity)


@query
def waiting_sql(fx):
    return sessions.waiting_sql(fx.fx_activity)


@query
def connections(fx):
    return sessions.connections(fx.fx_activity)


@query
def idle_in_transaction(fx):
    return sessions.idle_in_transaction(fx.fx_activity)


@query
def longest_sql_minutes(fx):
    return sessions.longest_sql_minutes(fx.fx_activity, AS_OF)


@query
def session_metrics(fx):
    return sessions.session_metrics(fx.fx_activity, AS_OF)


@query
def long_idle_transactions(fx):
    return sessions.long_idle_transactions(fx.fx_activity, AS_OF)


@query
def long_queries(fx):
    return sessions.long_queries(fx.fx_activity, AS_OF)


@query
def idle_session_candidates(fx):
    return sessions.idle_session_candidates(fx.fx_activity, AS_OF)


@query
def idle_session_candidates_by_start(fx):
    return sessions.idle_session_candidates(
        fx.fx_activity, AS_OF, timedelta(hours=1), timedelta(hours=24), by_state_change=False
    )


@query
def lock_waits(fx):
    return locks.lock_waits(fx.fx_locks, AS_OF)


@query
def lock_sessions(fx):
    return locks.lock_sessions(fx.fx_lock_rows, fx.fx_lock_activity)


@query
def lock_wait_pairs(fx):
    # The sessions that a person asks about.
    listed = fx.fx_lock_activity.filter("waiting").orderBy("pid").limit(5)
    return locks.lock_wait_pairs(locks.lock_sessions(fx.fx_lock_rows, fx.fx_lock_activity), listed, OPS_AS_OF)


@query
def longest_lock_wait(fx):
    return locks.longest_lock_wait(fx.fx_locks, AS_OF)


@query
def top_workfile(fx):
    return sessions.top_workfile(fx.fx_workfile)


@query
def resource_group_totals(fx):
    return sessions.resource_group_totals(fx.fx_resgroup)


@query
def resource_queue_counts(fx):
    return sessions.resource_queue_counts(fx.fx_resq)


@query
def orphan_temp_schemas(fx):
    return sessions.orphan_temp_schemas(fx.fx_namespace, fx.fx_activity)


# ---- cluster


@query
def segments_down(fx):
    return cluster.segments_down(fx.fx_segconf)


@query
def segments_out_of_sync(fx):
    return cluster.segments_out_of_sync(fx.fx_segconf)


@query
def role_switched(fx):
    return cluster.role_switched(fx.fx_segconf)


@query
def cluster_shape(fx):
    return cluster.cluster_shape(fx.fx_segconf)


@query
def host_lists(fx):
    return cluster.host_lists(fx.fx_segconf)


@query
def recent_config_changes(fx):
    return cluster.recent_config_changes(fx.fx_history)


# ---- logs


@query
def panic_events(fx):
    return logs.panic_events(fx.fx_log)


@query
def terminated_events(fx):
    return logs.terminated_events(fx.fx_log)


def _unexplained(fx):
    crashes = logs.crash_lines(fx.fx_log)
    return logs.terminated_without_panic(logs.terminated_events(crashes), logs.panic_events(crashes))


@query
def terminated_without_panic(fx):
    return _unexplained(fx)


@query
def session_log_tail(fx):
    return logs.session_log_tail(fx.fx_log)


@query
def session_log_tail_short(fx):
    return logs.session_log_tail(fx.fx_log, n=10)


@query
def process_log_tail(fx):
    return logs.process_log_tail(fx.fx_log, _unexplained(fx))


@query
def process_log_tail_short(fx):
    return logs.process_log_tail(fx.fx_log, _unexplained(fx), n=2)


@query
def pattern_counts(fx):
    return logs.pattern_counts(fx.fx_log, LOG_SINCE, coordinators=["host0"])


@query
def pattern_counts_by_host(fx):
    return logs.pattern_counts_by_host(fx.fx_log, LOG_SINCE, coordinators=["host0"])


# ---- monitoring and privileges


@query
def latest_metrics(fx):
    return monitor.latest_metrics(fx.fx_history)


@query
def due_metrics(fx):
    return monitor.due_metrics(fx.fx_setup, AS_OF)


@query
def start_checks(fx):
    return monitor.start_checks(fx.fx_setup, AS_OF).select("monitor_id", "status", "last_finishtime")


@query
def record_results(fx):
    ran = monitor.latest_metrics(fx.fx_history)
    return monitor.record_results(fx.fx_metric_setup, ran, AS_OF).select("metric_name", "status", "last_finishtime")


@query
def reset_checks(fx):
    return monitor.reset_checks(fx.fx_setup).select("monitor_id", "status", "last_finishtime")


@query
def drop_expired(fx):
    path = fresh_dir(fx.spark, "retention")
    sinks.append_history(fx.fx_history, path)
    sinks.drop_expired(fx.spark, path, AS_OF, 14)
    return fx.spark.read.parquet(path).select(*fx.fx_history.columns)


@query
def apply_retention(fx):
    return monitor.apply_retention(fx.fx_history, AS_OF, 14)


@query
def evaluate_alerts(fx):
    return monitor.evaluate_alerts(monitor.latest_metrics(fx.fx_history), fx.fx_alert_setup)


@query
def log_metrics_since_last_check(fx):
    return collect_metrics({"lines": fx.fx_log}, AS_OF, coordinators=("host0",), history=fx.fx_log_checks)


@query
def metric_results(fx):
    return collect_metrics(
        {
            "conf": fx.fx_segconf,
            "workfiles": fx.fx_workfile,
            "locks": fx.fx_locks,
            "activity": fx.fx_activity,
            "resource_groups": fx.fx_resgroup,
            "resource_queues": fx.fx_resq,
            "processes": fx.fx_proc,
            "lines": fx.fx_log,
            "dbs": fx.fx_db_age,
        },
        AS_OF,
        LOG_SINCE,
        ("host0",),
    )


def _health_inputs(fx):
    return {
        "conf": fx.fx_segconf,
        "config_history": fx.fx_history.select("ctime", F.col("monitor_result").alias("desc")),
        "databases": fx.fx_rel_size.withColumnRenamed("schemaname", "datname"),
        "dbs": fx.fx_db_age,
        "activity": fx.fx_activity,
        "rels": fx.fx_rel,
        "attributes": fx.fx_attr,
        "catalog_sizes": fx.fx_cat_seg,
        "catalog_compact": fx.fx_catsize,
        "ops": fx.fx_ops,
        "sizes": fx.fx_rel_size,
        "indexes": fx.fx_index,
        "parts": fx.fx_parts,
        "visimap": fx.fx_visimap,
        "col_stats": fx.fx_colstats,
        "relpages": fx.fx_relpages,
        "settings": fx.fx_settings,
    }


@query
def health(fx):
    return health_report(_health_inputs(fx), AS_OF, N_SEGMENTS)


def _three(fx, name):
    """Three databases that share names and numbers of relations, but not all rows."""
    df = getattr(fx, name)
    parts = [df.filter(database_rows(database, name)).select(F.lit(database).alias("datname"), "*") for database in DATABASES]
    return reduce(DataFrame.unionByName, parts)


@query
def health_by_database(fx):
    inputs = _health_inputs(fx)
    for name, fixture in (
        ("rels", "fx_rel"), ("attributes", "fx_attr"), ("catalog_sizes", "fx_cat_seg"), ("catalog_compact", "fx_catsize"),
        ("ops", "fx_ops"), ("sizes", "fx_rel_size"), ("indexes", "fx_index"), ("parts", "fx_parts"), ("visimap", "fx_visimap"),
        ("col_stats", "fx_colstats"), ("relpages", "fx_relpages"),
    ):
        inputs[name] = _three(fx, fixture)
    return health_report(inputs, AS_OF, N_SEGMENTS, by=["datname"])


@query
def skew_check_by_database(fx):
    return skew.skew_check(
        _three(fx, "fx_rel_size"), N_SEGMENTS, policy=_three(fx, "fx_dk"), attributes=_three(fx, "fx_attr"), by=["datname"]
    )


@query
def high_age_relations_by_database(fx):
    return age.high_age_relations(_three(fx, "fx_rel_age"), _three(fx, "fx_rel"), n=500, by=["datname"])


@query
def changed_tables_by_database(fx):
    state = _three(fx, "fx_modcount_old").withColumn("last_checktime", F.lit(str(STATE_TIME)).cast("timestamp_ntz"))
    return change.changed_tables(state, _three(fx, "fx_modcount_new"), _three(fx, "fx_ops"), by=["datname"])


@query
def top_append_only_by_database(fx):
    return size.top_relations(_three(fx, "fx_rel_size"), size.APPEND_ONLY, 20, by=["datname"])


@query
def table_privileges(fx):
    return privileges.table_privileges(fx.fx_acl)


@query
def schema_privileges(fx):
    return privileges.schema_privileges(fx.fx_nsp_acl)


@query
def exact_privilege_roles(fx):
    return privileges.exact_privilege_roles(fx.fx_nsp_acl, "r")


@query
def acl_decoding(fx):
    item = F.col("item")
    return fx.fx_acl.select("reloid", F.posexplode("relacl").alias("pos", "item")).select(
        "reloid", "pos", acl.acl_role(item).alias("role"), acl.acl_table(item).alias("on_table"), acl.acl_schema(item).alias("on_schema")
    )


# ---- streaming


def _landed(fx, df, label):
    path = fresh_dir(fx.spark, label)
    df.write.parquet(path)
    return path


@query
def stream_log_alerts(fx):
    source, work = fresh_dir(fx.spark, "log-in"), fresh_dir(fx.spark, "log-alerts")
    fx.fx_log.write.text(source)
    alerts = stream_logs.log_alerts(stream_logs.stream_log_lines(fx.spark, source), coordinators=["host0"])
    stream_sinks.run_updates(alerts, f"{work}/out", f"{work}/cp").awaitTermination()
    return stream_sinks.read_updates(fx.spark, f"{work}/out", ["window_start", "window_end", "hostname", "pattern"])


def _backfill(fx):
    """Lines of the whole log in four batches that overlap in time, some of them without one."""
    source, work = fresh_dir(fx.spark, "backfill-in"), fresh_dir(fx.spark, "backfill")
    for batch in range(4):
        fx.fx_log_backfill.filter(F.col("batch") == batch).select("log_msg").write.mode("append").text(source)
        lines = stream_logs.stream_log_lines(fx.spark, source)
        stream_logs.stream_log_alerts(lines, work, f"{work}/cp", coordinators=["host0"]).awaitTermination()
    return work


@query
def stream_log_account(fx):
    return stream_logs.read_account(fx.spark, _backfill(fx))


@query
def stream_log_backfill(fx):
    return stream_logs.read_alerts(fx.spark, _backfill(fx))


@query
def stream_log_backfill_with_late(fx):
    return stream_logs.read_alerts(fx.spark, _backfill(fx), with_late=True, coordinators=["host0"])


@query
def stream_latest_metrics(fx):
    source, work = _landed(fx, fx.fx_history, "history-in"), fresh_dir(fx.spark, "history")
    stream = fx.spark.readStream.schema(fx.fx_history.schema).parquet(source)
    stream_metrics.stream_latest_metrics(stream, work, f"{work}/cp", f"{work}/text").awaitTermination()
    return stream_metrics.read_latest(fx.spark, work)


@query
def stream_metric_results(fx):
    # The second snapshot is spread over two batches; the third comes last.
    feed, minute = fx.fx_activity_feed, F.minute("snapshot_ts")
    spread = (minute == 5) & (F.col("pid") % 2 == 0)
    source, work = fresh_dir(fx.spark, "snapshot-in"), fresh_dir(fx.spark, "snapshot")
    for rows in (feed.filter((minute == 0) | spread), feed.filter((minute == 15) | (minute == 5) & ~spread), feed.filter(minute == 10)):
        rows.write.mode("append").parquet(source)
        stream = fx.spark.readStream.schema(feed.schema).parquet(source)
        stream_metrics.stream_metric_results(stream, work, f"{work}/cp", f"{work}/text").awaitTermination()
    return stream_metrics.read_results(fx.spark, work)


@query
def stream_changed_tables(fx):
    # Two snapshots come in one batch, one between them comes after it.
    feed, year = fx.fx_modcount_feed, F.date_format("snapshot_ts", "yyyy-MM")
    source, work = fresh_dir(fx.spark, "counters-in"), fresh_dir(fx.spark, "counters")
    for months in (["2000-01"], ["2000-06", "2001-08"], ["2001-01"]):
        feed.filter(year.isin(months)).write.mode("append").parquet(source)
        stream = fx.spark.readStream.schema(feed.schema).parquet(source)
        stream_changes.stream_changed_tables(stream, work, f"{work}/cp").awaitTermination()
    return stream_changes.read_changes(fx.spark, work)


@query
def stream_session_alerts(fx):
    source, work = _landed(fx, fx.fx_activity_snap, "activity-in"), fresh_dir(fx.spark, "activity")
    stream = fx.spark.readStream.schema(fx.fx_activity_snap.schema).parquet(source)
    alerts = stream_sessions.session_alerts(stream)
    stream_sinks.run_updates(alerts, f"{work}/out", f"{work}/cp").awaitTermination()
    return stream_sinks.read_updates(fx.spark, f"{work}/out", ["window_start"])
