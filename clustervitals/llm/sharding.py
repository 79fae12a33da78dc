"""Shards along a Hilbert curve over metadata, so that files can be skipped by several columns.

Each dimension is quantised to ``BITS`` bits, the bits become a place on the
curve, rows are sorted by it and the sorted run is cut into shards of equal row
counts.  Rows that are alike in all dimensions get near places, so a shard
spans a small box; ``shard_boxes`` gives the boxes and ``shards_for`` the
shards that a query needs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.spread import lookup_join, running_total

BITS = 8


def by_hash(column: Column, bits: int = BITS) -> Column:
    """A cell for values that are looked up by equality; a null has a cell like any value."""
    return F.pmod(F.xxhash64(F.coalesce(column.cast("string"), F.lit("\0"))), F.lit(1 << bits)).cast("int")


def by_magnitude(column: Column, bits: int = BITS, doublings: int = 32) -> Column:
    """A cell that grows with the logarithm of a count, for range queries; nulls are 0."""
    step = (1 << bits) / doublings
    cell = F.floor(F.log2(F.greatest(F.coalesce(column, F.lit(0)), F.lit(0)) + 1) * step)
    return F.least(cell, F.lit((1 << bits) - 1)).cast("int")


def with_hilbert(rows: DataFrame, cells: Sequence[str], name: str = "hilbert", bits: int = BITS) -> DataFrame:
    """Adds the place on the Hilbert curve of a point with ``bits`` bits in each dimension.

    The coordinates are transformed in place from the highest bit down (a bit
    set inverts the lower bits of the first coordinate, else they are exchanged
    with it), Gray-coded, and their bits interleaved.  Each step is a column of
    its own, so that it is computed once.
    """
    n = len(cells)
    start = F.array(*(F.col(c).cast("int") for c in cells))

    def step(x: Column, k: Column) -> Column:
        bit, axis = F.get(k, F.lit(0)), F.get(k, F.lit(1))
        low, first, other = bit - 1, F.get(x, F.lit(0)), F.get(x, axis)
        is_set = other.bitwiseAND(bit) != 0
        moved = first.bitwiseXOR(other).bitwiseAND(low)
        new_first = F.when(is_set, first.bitwiseXOR(low)).otherwise(first.bitwiseXOR(moved))
        new_other = F.when(is_set, other).otherwise(other.bitwiseXOR(moved))
        return F.transform(x, lambda v, j: F.when(j == 0, new_first).when(j == axis, new_other).otherwise(v))

    steps = F.array(*(F.array(F.lit(1 << b), F.lit(axis)) for b in range(bits - 1, 0, -1) for axis in range(n)))
    turned = F.aggregate(steps, start, step) if bits > 1 else start
    turned_rows = rows.withColumn("_turned", turned)
    gray = [F.get("_turned", F.lit(0))]
    for axis in range(1, n):
        gray.append(gray[-1].bitwiseXOR(F.get("_turned", F.lit(axis))))
    gray_rows = turned_rows.withColumn("_gray", F.array(*gray))
    last, flips = F.get("_gray", F.lit(n - 1)), F.lit(0)
    for b in range(bits - 1, 0, -1):
        flips = flips.bitwiseXOR(F.when(last.bitwiseAND(F.lit(1 << b)) != 0, F.lit((1 << b) - 1)).otherwise(F.lit(0)))
    flipped = gray_rows.withColumn("_flips", flips)
    place = F.lit(0).cast("long")
    for b in range(bits - 1, -1, -1):
        for axis in range(n):
            own = F.shiftright(F.get("_gray", F.lit(axis)).bitwiseXOR(F.col("_flips")), b).bitwiseAND(F.lit(1))
            place = F.shiftleft(place, 1).bitwiseOR(own.cast("long"))
    return flipped.withColumn(name, place).drop("_turned", "_gray", "_flips")


def shards_by_curve(
    docs: DataFrame, cells: dict[str, Column], n_shards: int, order: Sequence[str], bits: int = BITS, n_rows: int | None = None
) -> DataFrame:
    """Rows of ``docs`` with their cells, ``hilbert``, ``shard`` from 0 and gapless ``slot`` from 0.

    Row counts of shards differ by one at most.  Rows at one place of the curve
    are sorted by ``order``; rows equal in all of that are interchangeable.
    Columns named like the new ones are replaced.
    """
    total = docs.count() if n_rows is None else n_rows
    rows = docs.withColumns(cells).withColumn("_one", F.lit(1).cast("long"))
    placed = with_hilbert(rows, list(cells), "hilbert", bits)
    ranked = running_total(placed, [], ["hilbert", *order], "_one", "_place")
    return (
        ranked.withColumn("shard", F.expr(f"cast((_place - 1) * {n_shards} div {max(total, 1)} as int)"))
        .withColumn("slot", F.expr(f"_place - 1 - (shard * {total}L + {n_shards - 1}) div {n_shards}"))
        .drop("_one", "_place")
    )


def with_kind_of_group(docs: DataFrame, group: str, kind: str) -> DataFrame:
    """The rows with ``kind`` as the smallest of all rows of their ``group``.

    Only groups of several kinds need theirs looked up, and a group of very many rows meets it in many tasks.
    """
    kinds = docs.groupBy(group).agg(F.min(kind).alias("least"), F.max(kind).alias("most"))
    several = kinds.filter(~F.col("least").eqNullSafe(F.col("most"))).select(group, "least")
    return lookup_join(docs, several, [group], "left").withColumn(kind, F.coalesce("least", kind)).drop("least")


def shard_boxes(sharded: DataFrame, cells: Sequence[str]) -> DataFrame:
    """Per shard its row count and the least and greatest cell of each dimension."""
    ends = [f(c).alias(f"{name}_{c}") for c in cells for name, f in (("min", F.min), ("max", F.max))]
    return sharded.groupBy("shard").agg(F.count("*").alias("rows"), *ends)


def shards_for(boxes: DataFrame, wanted: dict[str, tuple[int, int]]) -> DataFrame:
    """The shards whose box meets the wanted range of cells in every dimension named."""
    for c, (low, high) in wanted.items():
        boxes = boxes.filter((F.col(f"min_{c}") <= high) & (F.col(f"max_{c}") >= low))
    return boxes.select("shard")
