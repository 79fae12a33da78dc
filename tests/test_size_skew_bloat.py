"""Boundary cases of size, skew and bloat figures."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from clustervitals.functions import names
from clustervitals.operators import bloat, size, skew, spread

SIZES = "schemaname string, relname string, reloid long, segid int, size_bytes long, relfilecount long, relstorage string, spcname string"


def sizes(spark, rows):
    return spark.createDataFrame(rows, SIZES)


def seg(name, segid, nbytes, storage="h", schema="s", files=1, space=None):
    return (schema, name, 1, segid, nbytes, files, storage, space)


def test_skew_threshold_is_strict(spark):
    # 3 of 4 segments at 1, one at x: skew is (x - avg) / avg.
    at_limit = [seg("t", i, 100) for i in range(3)] + [seg("t", 3, 180)]  # avg 120, skew 0.5
    above = [seg("u", i, 100) for i in range(3)] + [seg("u", 3, 181)]
    got = skew.skew_check(sizes(spark, at_limit + above), 4, min_total=0).collect()
    assert [r.tablename for r in got] == ["s.u"]


def test_skew_total_limit_is_strict(spark):
    rows = [seg("t", 0, 1000), seg("u", 0, 1001)]
    got = skew.skew_check(sizes(spark, rows), 2, min_total=1000).collect()
    assert [r.tablename for r in got] == ["s.u"]


def test_one_segment_has_skew_zero_and_is_reported(spark):
    (row,) = skew.skew_check(sizes(spark, [seg("t", 5, 10)]), 8, min_total=0).collect()
    assert (row.data_segcount, row.maxsize_segid, float(row.skew), row.dk) == (1, 5, 0.0, None)


def test_skew_tie_takes_lowest_segment_and_leaves_roll_up(spark):
    rows = [seg("t_1_prt_1", 2, 50), seg("t_1_prt_2", 2, 50), seg("t_1_prt_1", 1, 100), seg("t_1_prt_1", 0, 0)]
    (row,) = skew.skew_check(sizes(spark, rows), 8, min_total=0).collect()
    assert (row.tablename, row.data_segcount, row.maxsize_segid, row.maxsize_bytes) == ("s.t", 2, 1, 100)


def test_external_tables_are_not_skewed(spark):
    assert skew.skew_check(sizes(spark, [seg("t", 0, 10, "x")]), 8, min_total=0).isEmpty()


def test_coordinator_is_no_segment(spark):
    rows = [seg("t", -1, 500), seg("t", 0, 10), seg("t", 1, 10)]
    assert skew.skew_check(sizes(spark, rows), 2, min_total=0).isEmpty()


def test_skew_of_nothing(spark):
    assert skew.skew_check(sizes(spark, []), 8).isEmpty()


def test_skew_order(spark):
    rows = [seg("b", 0, 20), seg("a", 0, 10), seg("c", 0, 5), seg("c", 1, 5)]
    got = [r.tablename for r in skew.skew_check(sizes(spark, rows), 8, min_total=0).collect()]
    assert got == ["s.b", "s.a", "s.c"]


def test_schema_and_tablespace_totals_agree(spark):
    rows = sizes(spark, [seg("a", 0, 7, space="x"), seg("b", 1, 5), seg("c", 1, 3, schema="q")])
    by_schema = size.schema_size(rows).agg(F.sum("size_bytes")).first()[0]
    by_space = {r.tsname: r.size_bytes for r in size.tablespace_size(rows).collect()}
    assert by_schema == sum(by_space.values()) == 15
    assert by_space == {"x": 7, "pg_default": 8}


def test_tablespace_order(spark):
    rows = sizes(spark, [seg("a", 0, 1, space="a"), seg("b", 0, 2, space="b")])
    assert [r.tsname for r in size.tablespace_size(rows).collect()] == ["a", "b"]
    assert [r.tsname for r in size.tablespace_size(rows, by_size=True).collect()] == ["b", "a"]


def test_partition_table_without_leaves_is_null(spark):
    rows = sizes(spark, [seg("p_1_prt_1", 0, 4), seg("p_1_prt_2", 0, 5), seg("plain", 0, 9)])
    tables = spark.createDataFrame([("s", "p"), ("s", "plain")], "schemaname string, relname string")
    got = {r.relname: r.size_bytes for r in size.partition_table_size(rows, tables).collect()}
    assert got == {"p": 9, "plain": None}


def test_forks_and_parts_of_data_files(spark):
    files = spark.createDataFrame(
        [("16", 10, datetime(2024, 1, 1)), ("16.1", 5, datetime(2024, 1, 2)), ("16_fsm", 99, datetime(2024, 1, 3))],
        "filename string, size_bytes long, modtime timestamp",
    )
    rels = spark.createDataFrame([(1, "t", "s", 16), (2, "u", "s", 17)], "reloid long, relname string, schemaname string, relfilenode long")
    (row,) = size.relation_files(files, rels).collect()
    assert (row.reloid, row.size_bytes, row.relfilecount, row.max_modtime) == (1, 15, 2, datetime(2024, 1, 2))


def test_pretty_size_steps(spark):
    cases = {
        0: "0 bytes", 10239: "10239 bytes", 10240: "10 kB", 10752: "11 kB", 10751: "10 kB",
        10239 * 1024: "10239 kB", 10240 * 1024 - 512: "10 MB", 10 * 1024**3: "10 GB",
        1024**4: "1024 GB", 10 * 1024**4: "10 TB", 20000 * 1024**4: "20000 TB",
    }
    df = spark.createDataFrame([(k,) for k in cases], "b long").select("b", names.pretty_size(F.col("b")).alias("s"))
    assert {r.b: r.s for r in df.collect()} == cases


def test_retention_counts_whole_days(spark):
    now = datetime(2024, 1, 31)
    rows = [
        ("a.log", timedelta(days=31)), ("b.log", timedelta(days=31, seconds=-1)), ("c.csv.gz", timedelta(days=31)),
        ("d.csv", timedelta(days=6)), ("e.csv", timedelta(days=6, seconds=-1)), ("f.csv.gz", timedelta(days=20)), ("g.txt", timedelta(days=99)),
    ]
    files = spark.createDataFrame([(n, 1, now - a) for n, a in rows], "filename string, size_bytes long, modtime timestamp_ntz")
    got = {r.filename: r.action for r in size.retention_plan(files, now).collect()}
    assert got == {
        "a.log": "delete", "b.log": "compress", "c.csv.gz": "delete",
        "d.csv": "compress", "e.csv": "keep", "f.csv.gz": "keep", "g.txt": "keep",
    }


def test_ao_bloat_extremes(spark):
    rows = [(1, "s", "all", 0, 5, 5), (2, "s", "none", 0, 0, 5), (3, "s", "empty", 0, 0, 0), (4, "s", "split", 0, 1, 2), (4, "s", "split", 1, 0, 1)]
    df = spark.createDataFrame(rows, "reloid long, schemaname string, tablename string, segid int, hidden long, total long")
    got = {r.tablename: (r.percent_hidden, r.bloat) for r in bloat.ao_bloat(df).collect()}
    assert got["empty"][0] == 0 and got["split"][0] == 33.33
    assert abs(got["all"][1] - 1000) < 1e-6 and abs(got["none"][1] - 100 / 100.1) < 1e-9
    assert {r.tablename for r in bloat.ao_bloat(df, min_bloat=1.9).collect()} == {"all"}
    assert bloat.ao_bloat(df, schemas=["other"]).isEmpty()


def heap_inputs(spark, tuples, pages, null_frac=0.0, width=4):
    stats = spark.createDataFrame([("s", "t", null_frac, width)], "schemaname string, tablename string, null_frac double, avg_width int")
    rels = spark.createDataFrame([("s", "t", float(tuples), pages)], "schemaname string, relname string, reltuples double, relpages long")
    return stats, rels


def test_heap_bloat_without_live_pages(spark):
    (row,) = bloat.heap_bloat(*heap_inputs(spark, 0, 5000)).collect()
    assert (row.live_pages, float(row.bloat), row.wasted_bytes) == (0, 1000.0, 5000 * 32768)


def test_heap_bloat_row_width(spark):
    # data 4 + header 28 = 32 is aligned; rows of 32 + 4 bytes; no nulls.
    (row,) = bloat.heap_bloat(*heap_inputs(spark, 32748, 40000)).collect()
    assert row.live_pages == 36
    # half the values null: data 2 + 28 = 30 padded to 32, null header 28 weighs half, plus 4.
    (row,) = bloat.heap_bloat(*heap_inputs(spark, 32748, 40000, null_frac=0.5)).collect()
    assert row.live_pages == 50


def test_heap_bloat_filters_on_rounded_ratio(spark):
    # live 2000 pages: 4080 / 2000 = 2.04 rounds to 2.0, which is not above 2; 4120 / 2000 rounds to 2.1.
    tuples = 2000 * 32748 / 36
    low = bloat.heap_bloat(*heap_inputs(spark, tuples, 4080), min_wasted=0)
    high = bloat.heap_bloat(*heap_inputs(spark, tuples, 4120), min_wasted=0)
    assert low.isEmpty() and float(high.first().bloat) == 2.1


def test_bloat_report_order(spark):
    heap = spark.createDataFrame([("s", "h1", 3.0), ("s", "h2", 9.0)], "schemaname string, tablename string, bloat double")
    ao = spark.createDataFrame([("s", "a1", 1.9), ("s", "a2", 5.0)], "schemaname string, tablename string, bloat double")
    got = [(r.relstorage, r.tablename) for r in bloat.bloat_report(heap, ao).collect()]
    assert got == [("ao", "s.a2"), ("h", "s.h2"), ("h", "s.h1")]


def test_catalog_bloat_of_empty_copy_is_null(spark):
    actual = spark.createDataFrame([("c", -1, 100, 7), ("c", 0, 50, 9)], "catalog string, segid int, size_bytes long, row_count long")
    compact = spark.createDataFrame([("c", 0)], "catalog string, compact_bytes long")
    (row,) = bloat.catalog_bloat(actual, compact).collect()
    assert (row.row_count, row.size_total, row.size_coordinator, row.size_seg0, row.bloat) == (7, 150, 100, 50, None)


def test_distribution_key_keeps_key_order_and_all_columns(spark):
    policy = spark.createDataFrame([(1, "s.t", ["3", "1"]), (2, "s.r", None)], "reloid long, tablename string, distkey array<string>")
    attrs = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "c")], "reloid long, attnum int, attname string")
    assert {r.tablename: r.dk for r in skew.distribution_key(policy, attrs).collect()} == {"s.t": "c,a", "s.r": None}


def test_skew_names_the_distribution_key_on_both_join_paths(spark, monkeypatch):
    data = sizes(spark, [seg("t", 0, 10), seg("r", 0, 10), seg("p_1_prt_1", 0, 10)])
    policy = spark.createDataFrame(
        [(1, "s.t", ["2", "1"]), (2, "s.r", None), (3, "s.p_1_prt_1", ["1"]), (4, "s.p", ["1"])],
        "reloid long, tablename string, distkey array<string>",
    )
    attrs = spark.createDataFrame([(i, n, f"c{n}") for i in (1, 3, 4) for n in (1, 2)], "reloid long, attnum int, attname string")
    for limit in (spread.BROADCAST_BYTES, -1):
        monkeypatch.setattr(spread, "BROADCAST_BYTES", limit)
        got = skew.skew_check(data, 2, min_total=0, policy=policy, attributes=attrs).collect()
        assert {r.tablename: r.dk for r in got} == {"s.t": "c2,c1", "s.r": None, "s.p": "c1"}


def test_nodes_are_unique_per_segment_and_database_only(spark):
    files = spark.createDataFrame(
        [(0, "a", "100", 1), (1, "a", "100", 2), (1, "a", "100.1", 4), (0, "b", "100", 8)],
        "segid int, datname string, filename string, size_bytes long",
    ).withColumn("modtime", F.current_timestamp())
    rels = spark.createDataFrame(
        [(0, "a", 1, 100), (0, "a", 2, 101), (1, "a", 2, 100), (1, "a", 1, 101), (0, "b", 1, 100)],
        "segid int, datname string, reloid long, relfilenode long",
    )
    got = {(r.segid, r.datname, r.reloid): (r.size_bytes, r.relfilecount) for r in size.relation_files(files, rels).collect()}
    assert got == {(0, "a", 1): (1, 1), (1, "a", 2): (6, 2), (0, "b", 1): (8, 1)}
