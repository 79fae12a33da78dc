"""Boundary cases of inventory, change detection, age and scoping."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from clustervitals.functions import names
from clustervitals.operators import age, change, inventory, scope
from clustervitals.operators import remediation as fix

NOW = datetime(2024, 1, 31)
REL = (
    "reloid long, schemaname string, schemaoid long, relname string, relkind string, relstorage string, "
    "relhassubclass boolean, relispartition boolean"
)


def rel(oid, name, schema="s", schemaoid=20000, kind="r", storage="h", parent=False, part=False):
    return (oid, schema, schemaoid, name, kind, storage, parent, part)


def test_scope_modes(spark):
    df = spark.createDataFrame([(n,) for n in ("dw", "pg_catalog", "gpp_sync", "information_schema", "ods")], "schemaname string")

    def pick(**mode):
        return {r.schemaname for r in scope.schema_scope(df, **mode).collect()}

    assert pick(all_schemas=True) == {"dw", "ods"}
    assert pick(exclude=["dw"]) == {"ods"}
    assert pick(include=["pg_catalog", "dw"]) == {"pg_catalog", "dw"}
    assert pick(all_schemas=True, prefixes=("pg_",)) == {"dw", "ods", "gpp_sync"}
    with pytest.raises(ValueError):
        scope.schema_scope(df)
    with pytest.raises(ValueError):
        scope.schema_scope(df, include=["a"], all_schemas=True)


def test_long_scope_lists_and_none(spark):
    df = spark.createDataFrame([("dw",), ("ods",)], "schemaname string")
    many = [f"x{i}" for i in range(3000)]
    assert scope.schema_scope(df, include=[*many, "dw"]).collect() == [("dw",)]
    assert scope.schema_scope(df, exclude=[*many, "dw"]).collect() == [("ods",)]
    with pytest.raises(ValueError):
        scope.schema_scope(df, exclude=["dw", None])


def test_schema_list_file():
    assert scope.read_schema_list(["# comment", "", " dw ", "ods\n", "  "]) == ["dw", "ods"]


def test_partition_mark_is_literal(spark):
    df = spark.createDataFrame([("a_1_prt_x_1_prt_y",), ("aX1XprtXb",), ("plain",)], "n string")
    assert [r[0] for r in df.select(names.partition_root(F.col("n"))).collect()] == ["a", "aX1XprtXb", "plain"]


def test_user_relations(spark):
    df = spark.createDataFrame(
        [
            rel(20001, "ok"), rel(100, "low"), rel(20002, "pub", "public", 2200), rel(20003, "cat", "pg_catalog", 11),
            rel(20004, "tmp", "pg_temp_3"), rel(20005, "ext", storage="x"), rel(20006, "foreign", kind="f"),
            rel(16384, "edge"), rel(20007, "alike", "pgXtemp"),
        ],
        REL,
    )
    assert {r.relname for r in scope.user_relations(df).collect()} == {"ok", "pub", "alike"}


def test_data_tables_keep_deepest_level_only(spark):
    rels = spark.createDataFrame([rel(20000 + i, n) for i, n in enumerate(["root", "mid", "leaf", "plain"])], REL)
    parts = spark.createDataFrame(
        [("s", "root", 0, "mid"), ("s", "root", 1, "leaf")],
        "schemaname string, tablename string, partitionlevel int, partitiontablename string",
    )
    assert {r.relname for r in change.data_tables(rels, parts).collect()} == {"leaf", "plain"}


def state(spark, rows):
    return spark.createDataFrame(rows, "reloid long, modcount long, last_checktime timestamp_ntz")


def counts(spark, rows):
    return spark.createDataFrame(rows, "reloid long, modcount long")


def test_changed_tables(spark):
    checked = datetime(2024, 1, 1)
    old = state(spark, [(1, 5, checked), (2, 5, checked), (3, 5, checked), (4, 5, checked)])
    new = counts(spark, [(1, 5), (2, 6), (3, 6), (4, 6), (9, 0)])
    ops = spark.createDataFrame(
        [(2, "ANALYZE", checked), (3, "ANALYZE", checked - timedelta(seconds=1)), (4, "VACUUM", checked), (9, "ANALYZE", NOW)],
        "objid long, actionname string, statime timestamp_ntz",
    )
    got = {(r.reloid, r.reason) for r in change.changed_tables(old, new, ops).collect()}
    # 1 did not move; 2 was analyzed at the check; 9 is new and so has no check to compare with.
    assert got == {(3, "changed"), (4, "changed"), (9, "new")}


def test_changed_tables_uses_latest_state(spark):
    old = state(spark, [(1, 5, datetime(2024, 1, 1)), (1, 6, datetime(2024, 1, 2))])
    assert change.changed_tables(old, counts(spark, [(1, 6)])).isEmpty()


def test_changed_tables_with_empty_state(spark):
    assert change.changed_tables(state(spark, []), counts(spark, [(1, 0)])).first().reason == "new"


def test_refresh_state(spark):
    t = datetime(2024, 1, 1)
    old = state(spark, [(1, 1, t), (2, 2, t), (3, 3, t)])
    live = spark.createDataFrame([(1,), (2,)], "reloid long")
    got = {tuple(r) for r in change.refresh_state(old, counts(spark, [(1, 9), (7, 0)]), live, NOW).collect()}
    assert got == {(1, 9, NOW), (7, 0, NOW), (2, 2, t)}


def test_mod_counts_of_tables_without_segments(spark):
    seg = spark.createDataFrame([(1, 0, 2), (1, 1, 3), (2, 0, None)], "reloid long, segid int, modcount long")
    tables = spark.createDataFrame([(1,), (2,), (3,)], "reloid long")
    assert {tuple(r) for r in change.mod_counts(seg, tables).collect()} == {(1, 5), (2, 0), (3, 0)}


def test_stale_stats_is_strict_on_three_days(spark):
    rels = spark.createDataFrame([rel(1, "a"), rel(2, "b"), rel(3, "c"), rel(4, "ao", storage="a"), rel(5, "root", parent=True)], REL)
    ops = spark.createDataFrame(
        [(1, "ANALYZE", NOW - timedelta(days=3)), (2, "ANALYZE", NOW - timedelta(days=3, microseconds=1)), (3, "VACUUM", NOW)],
        "objid long, actionname string, statime timestamp_ntz",
    )
    assert {r.relname for r in change.stale_stats(rels, ops, NOW).collect()} == {"b", "c"}


def test_high_age_skips_never_freezing_and_takes_segment_maximum(spark):
    ages = spark.createDataFrame(
        [(1, -1, 10), (1, 0, 500), (1, 1, 400), (2, 0, 2147483647), (3, 0, 100), (4, 0, 900), (5, 0, 901)],
        "reloid long, segid int, age_int long",
    )
    rels = spark.createDataFrame(
        [rel(1, "t"), rel(2, "u"), rel(3, "v"), rel(4, "p_1_prt_1"), rel(5, "p_1_prt_2", parent=True)], REL
    )
    roots = [(r.relname, r.age_int) for r in age.high_age_relations(ages, rels, level=100).collect()]
    leaves = [(r.relname, r.age_int) for r in age.high_age_relations(ages, rels, leaves=True, level=100).collect()]
    assert roots == [("p_1_prt_2", 901), ("t", 500)] and leaves == [("p_1_prt_1", 900)]


def test_high_age_auxiliary_matches_kind(spark):
    aux = spark.createDataFrame([(11, "o", 500), (12, "o", 900), (13, "b", 700)], "auxoid long, relkind string, age_int long")
    links = spark.createDataFrame([(1, 11, 12, 13)], "relid long, segrelid long, visimaprelid long, blkdirrelid long")
    # 12 is a visibility map by its link but says it is a segment file, so it does not count.
    assert [tuple(r) for r in age.high_age_auxiliary(aux, links, level=100).collect()] == [(1, 700)]


def test_inventory_of_access_methods(spark):
    df = spark.createDataFrame([("s", "r", "heap"), ("s", "f", None), ("s", "p", "heap"), ("s", "p", None)], "schemaname string, relkind string, amname string")
    got = {(r.tabletype, r.n) for r in inventory.storage_totals(df).collect()}
    assert got == {("heap", 2), ("foreign table", 1)}


def test_statements_quote_identifiers(spark):
    df = spark.createDataFrame([('we"ird', "T.1")], "schemaname string, relname string")
    (row,) = fix.remediation_statements(df, "freeze").collect()
    assert row.statement == 'VACUUM FREEZE "we""ird"."T.1";'
    joined = spark.createDataFrame([("s.a.b",)], "tablename string")
    assert fix.remediation_statements(joined, "vacuum").first().statement == 'VACUUM "s"."a.b";'
    assert fix.remediation_statements(spark.createDataFrame([("db",)], "datname string"), "vacuum_database").first().statement == 'vacuumdb "db";'
