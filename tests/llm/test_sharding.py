import itertools
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from clustervitals.llm import queries, sharding


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2), (3, 3), (4, 2), (1, 4)])
def test_curve_visits_neighbours(spark, dims, bits):
    points = list(itertools.product(range(1 << bits), repeat=dims))
    rows = spark.createDataFrame(points, ", ".join(f"x{k} int" for k in range(dims)))
    found = sharding.with_hilbert(rows, rows.columns, "h", bits).collect()
    path = [tuple(r)[:dims] for r in sorted(found, key=lambda r: r.h)]
    assert sorted(r.h for r in found) == list(range(len(points)))
    assert path[0] == (0,) * dims
    for a, b in zip(path, path[1:]):
        assert sum(abs(x - y) for x, y in zip(a, b)) == 1


def check_rows_law(rows, n_shards):
    counts = Counter(r.shard for r in rows)
    assert set(counts) <= set(range(n_shards))
    sizes = [counts.get(s, 0) for s in range(n_shards)]
    assert max(sizes) - min(sizes) <= 1
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_registered_query(spark, sf_dir):
    docs = {r.doc_id: r for r in queries.table(spark, sf_dir, "documents").collect()}
    rows = queries.QUERIES["op1_hilbert_shards"](spark, sf_dir).collect()
    assert len(rows) == len(docs)
    check_rows_law(rows, 24)
    for r in rows:
        raw = (docs[r.doc_id].text or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
    run = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [r.hilbert for r in run] == sorted(r.hilbert for r in run)
    # Equal texts lie side by side; only the end of a shard parts them.
    texts = [docs[r.doc_id].text or "" for r in run]
    assert len([k for k, (a, b) in enumerate(zip(texts, texts[1:])) if a != b]) + 1 == len(set(texts))
    cut = {texts[k] for k in range(1, len(run)) if texts[k] == texts[k - 1] and run[k].shard != run[k - 1].shard}
    assert len(cut) <= 23


def curve_place(point, bits):
    """The place of a point by going down the curve's cells, entry and direction of each kept as reflections."""
    n, place, entry, direction = len(point), 0, 0, 0

    def turn(x, k):
        k %= n
        return ((x >> k) | (x << (n - k))) & ((1 << n) - 1)

    def gray(k):
        return k ^ (k >> 1)

    def trailing_ones(k):
        return (~k & (k + 1)).bit_length() - 1

    for b in range(bits - 1, -1, -1):
        corner = sum(((x >> b) & 1) << k for k, x in enumerate(point))
        code = turn(corner ^ entry, direction + 1)
        w = next(k for k in range(1 << n) if gray(k) == code)
        place = (place << n) | w
        start = 0 if w == 0 else gray(2 * ((w - 1) // 2))
        entry ^= turn(start, n - (direction + 1) % n)
        axis = 0 if w == 0 else trailing_ones(w - 1) % n if w % 2 == 0 else trailing_ones(w) % n
        direction = (direction + axis + 1) % n
    return place


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2)])
def test_cells_of_every_level_are_filled_one_after_another(spark, dims, bits):
    """As on an independently built curve: each cell of half the size is left only when all its points are visited."""
    points = list(itertools.product(range(1 << bits), repeat=dims))
    rows = spark.createDataFrame(points, ", ".join(f"x{k} int" for k in range(dims)))
    found = {tuple(r)[:dims]: r.h for r in sharding.with_hilbert(rows, rows.columns, "h", bits).collect()}
    own = {p: curve_place(p, bits) for p in points}
    assert sorted(own.values()) == sorted(found.values())
    for level in range(1, bits):
        for places in (found, own):
            blocks = defaultdict(set)
            for p, h in places.items():
                blocks[tuple(x >> level for x in p)].add(h >> (dims * level))
            assert all(len(b) == 1 for b in blocks.values())
    path = sorted(own, key=own.get)
    assert all(sum(abs(x - y) for x, y in zip(a, b)) == 1 for a, b in zip(path, path[1:]))


def test_nulls_ties_and_clashing_names(spark):
    rows = [(None, None, None, 1), (1, None, "x", 2), (1, None, "x", 2), (2, "", None, 3)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, slot int")
    cells = {"a": sharding.by_hash(F.col("source")), "b": sharding.by_magnitude(F.length("text"))}
    check_rows_law(sharding.shards_by_curve(docs, cells, 7, ["doc_id"]).collect(), 7)
    assert sharding.shards_by_curve(docs.limit(0), cells, 7, ["doc_id"]).collect() == []


def test_boxes_prune_without_loss(spark):
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents")
    cells = {"a": sharding.by_hash(F.col("source")), "b": sharding.by_magnitude(F.col("n_chars"))}
    sharded = sharding.shards_by_curve(docs, cells, 24, ["doc_id"]).select("doc_id", "source", "shard", "a", "b").cache()
    boxes = sharding.shard_boxes(sharded, ["a", "b"])
    one = sharded.filter("source = 'src3'")
    cell = one.first().a
    kept = {r.shard for r in sharding.shards_for(boxes, {"a": (cell, cell)}).collect()}
    assert {r.shard for r in one.collect()} <= kept and len(kept) < 16
