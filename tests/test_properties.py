"""Generated inputs against small Python models."""

from decimal import ROUND_HALF_UP, Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clustervitals.functions import acl, logline, names
from clustervitals.operators import skew

FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def pretty(size: int) -> str:
    if size < 10240:
        return f"{size} bytes"
    for unit, bits in (("kB", 10), ("MB", 20), ("GB", 30), ("TB", 40)):
        rounded = ((size >> (bits - 1)) + 1) >> 1
        if rounded < 10240 or unit == "TB":
            return f"{rounded} {unit}"
    raise AssertionError


@FEW
@given(st.lists(st.integers(0, 1 << 60), min_size=1, max_size=60))
def test_pretty_size(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v long")
    assert [r[0] for r in df.select(names.pretty_size(F.col("v"))).collect()] == [pretty(v) for v in values]


NAME = st.text(alphabet="ab_1prt", max_size=24)


@FEW
@given(st.lists(NAME, min_size=1, max_size=60))
def test_partition_root(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [tuple(r) for r in df.select(names.partition_root(F.col("v")), names.is_leaf_name(F.col("v"))).collect()]
    assert got == [(v.split("_1_prt_")[0], "_1_prt_" in v) for v in values]


@FEW
@given(st.lists(st.text(alphabet=",:p1 ", max_size=30), min_size=1, max_size=60))
def test_log_fields_of_any_text(spark, values):
    def field(text, n):
        parts = text.split(",")
        return parts[n - 1] if n <= len(parts) else ""

    def colon(text, n):
        parts = text.split(":")
        return parts[n - 1] if n <= len(parts) else ""

    df = spark.createDataFrame([(v,) for v in values], "v string")
    line = F.col("v")
    got = df.select(logline.hostname(line), logline.log_file(line), logline.session_id(line)).collect()
    assert [tuple(r) for r in got] == [(v.split(":")[0], colon(v, 2), field(v, 10)) for v in values]


@FEW
@given(st.lists(st.text(alphabet="rawdDUCx", max_size=6), min_size=1, max_size=40))
def test_acl_words_keep_their_order(spark, flags):
    words = {"r": "Select;", "a": "Insert;", "w": "Update;", "d": "Delete;", "D": "Truncate;"}
    df = spark.createDataFrame([(f"bob={f}/own",) for f in flags], "v string")
    got = [r[0] for r in df.select(acl.acl_table(F.col("v"))).collect()]
    assert got == ["".join(w for c, w in words.items() if c in f) for f in flags]


@FEW
@given(
    st.dictionaries(
        st.tuples(st.sampled_from(["a", "b", "c_1_prt_1", "c_1_prt_2"]), st.integers(0, 3)),
        st.integers(0, 50), min_size=1, max_size=16,
    )
)
def test_skew_check_model(spark, cells):
    rows = [("s", name, 1, segid, size, 1, "h", None) for (name, segid), size in cells.items()]
    schema = "schemaname string, relname string, reloid long, segid int, size_bytes long, relfilecount long, relstorage string, spcname string"
    tables: dict[str, dict[int, int]] = {}
    for (name, segid), size in cells.items():
        segments = tables.setdefault("s." + name.split("_1_prt_")[0], {})
        segments[segid] = segments.get(segid, 0) + size
    expected = set()
    for name, segments in tables.items():
        held = {s: b for s, b in segments.items() if b > 0}
        total, n = sum(held.values()), len(held)
        if total <= 20:
            continue
        top = max(held.values())
        ratio = Decimal(top * n - total) / Decimal(total)
        if n < 4 or ratio > Decimal("0.5"):
            first = min(s for s, b in held.items() if b == top)
            expected.add((name, n, first, top, ratio.quantize(Decimal("0.01"), ROUND_HALF_UP)))
    got = skew.skew_check(spark.createDataFrame(rows, schema), 4, min_total=20).collect()
    assert {(r.tablename, r.data_segcount, r.maxsize_segid, r.maxsize_bytes, r.skew) for r in got} == expected
