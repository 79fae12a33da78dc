"""Exact top-k inner products by norm-bucketed retrieval.

Candidates are sorted by length and cut into buckets.  A first look at the
bucket of the longest ones gives every query a score it can reach for sure.
With that score a bucket implies a local cosine threshold: the least cosine
that its longest vector needs.  Over 1, the bucket is skipped.  If it is high,
coordinate pruning keeps the vectors whose largest query coordinates lie in the
interval that the cosine allows; else length pruning keeps a prefix of the
bucket.  What is left is verified with exact integer products.

Buckets and blocks of queries meet in a grid whose cells hold a bounded number
of both, and only where some query of the cell can need the bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.workspace import keep

BUCKET = 1024
QUERY_BLOCK = 256
# Buckets and blocks of queries in a cell of the grid.
_CELL = 4
# Local thresholds from here on are pruned by coordinates, others by length.
_COORDINATES_FROM = 0.3
_COORDINATES = 4
_SLACK = 1e-9
# Most of the first looks that go to every task: lengths of vectors, and bytes of all their buckets.
SEED_LENGTHS, SEED_BYTES = 16, 64 << 20
# Scores beyond a long travel as three longs, which are compared one after another, and as text.
_LIMB = 62


def quantised(vector: str, scale: int = 256) -> Column:
    """floor(scale * x) of each component x as double.

    Null if the vector or a component is null or not finite, or if a component's whole number does not fit a long.
    """
    column = F.transform(F.col(f"`{vector}`"), lambda x: x.cast("double") * scale)
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= float(1 << 63)))
    return F.when(~bad, F.transform(column, lambda x: F.floor(x).cast("long")))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _packed(size: int, order: str):
    """Rows in order become blocks of up to ``size``, never of different dimensions."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.Table] = []

        def block(table: pa.Table) -> pa.RecordBatch:
            dim = table.column("dim")[0].as_py()
            ids, bound = (table.column(c).to_numpy() for c in ("id", order))
            vectors = _matrix(table.column("v").combine_chunks(), dim).astype(np.int64)
            return pa.RecordBatch.from_pydict({
                "block": pa.array([int(ids[0])]), "dim": pa.array([dim], pa.int32()),
                "low": pa.array([float(bound.min())]), "high": pa.array([float(bound.max())]),
                "ids": pa.array([ids.astype(np.int64).tobytes()], pa.binary()),
                "bounds": pa.array([bound.astype(np.float64).tobytes()], pa.binary()),
                "vectors": pa.array([vectors.tobytes()], pa.binary()),
            })

        for batch in batches:
            table = pa.Table.from_batches([*([] if not waiting else waiting[0].to_batches()), batch])
            waiting = []
            dims = table.column("dim").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(dims)) + 1).tolist(), len(dims)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                while b - a >= size:
                    yield block(table.slice(a, size))
                    a += size
                if b > a and b < len(dims):
                    yield block(table.slice(a, b - a))
                elif b > a:
                    waiting = [table.slice(a, b - a)]
        if waiting:
            yield block(waiting[0])

    return pack


_WIDE = "query_id long, id long, high long, middle long, low long, text string"
_BLOCK = "block long, dim int, low double, high double, ids binary, bounds binary, vectors binary"


def _blocks(rows: DataFrame, order: str, size: int) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, "dim", order, "id").sortWithinPartitions("dim", F.desc(order), "id")
    return keep(dealt.select("id", "dim", order, "v").mapInArrow(_packed(size, order), _BLOCK))


class _Bucket:
    def __init__(self, ids: bytes, norms: bytes, vectors: bytes, dim: int):
        self.ids, self.norms = np.frombuffer(ids, np.int64), np.frombuffer(norms, np.float64)
        self.vectors = np.frombuffer(vectors, np.int64).reshape(-1, dim)
        self.exact = self.vectors.astype(np.float64)
        self.top = int(np.abs(self.exact).max(initial=0))
        self.unit = self.exact / np.maximum(self.norms, 1e-300)[:, None]
        self.longest = float(self.norms.max(initial=0))

    def survivors(self, query: np.ndarray, norm: float, floor: float) -> np.ndarray:
        """Places of the vectors whose product with the query can reach ``floor``."""
        if floor <= 0 or norm == 0:
            return np.arange(len(self.ids)) if floor <= 0 else np.zeros(0, np.int64)
        cosine = floor / norm / max(self.longest, 1e-300) - _SLACK
        if cosine > 1:
            return np.zeros(0, np.int64)
        if cosine < _COORDINATES_FROM:
            need = floor / norm * (1 - _SLACK)
            return np.arange(int(np.searchsorted(-self.norms, -need, "right")))
        unit, left = query / norm, np.arange(len(self.ids))
        for f in np.argsort(-np.abs(unit))[:_COORDINATES].tolist():
            # The most that the cosine can be, given one coordinate of both.
            x = self.unit[left, f]
            most = unit[f] * x + np.sqrt(max(0.0, 1 - unit[f] ** 2) * np.maximum(0.0, 1 - x**2))
            left = left[most >= cosine]
        return left

    def products(self, places: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Exact products, as longs where they fit and Python integers beyond."""
        largest = self.top * int(np.abs(query.astype(np.float64)).max(initial=0)) * len(query)
        if largest < 1 << 52:
            return (self.exact[places] @ query.astype(np.float64)).astype(np.int64)
        if largest < 1 << 62:
            return self.vectors[places] @ query
        return self.vectors[places].astype(object) @ query.astype(object)


def _best(k: int, ids: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Places of the k best, ties to the smaller id."""
    places = np.arange(len(ids))
    if scores.dtype == object:
        return np.array(sorted(places.tolist(), key=lambda p: (-scores[p], ids[p]))[:k], np.int64)
    if len(ids) > 4 * k:
        places = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return places[np.lexsort((ids[places], -scores[places]))[:k]]


def _query_floors(seeds, k: int):
    """Queries with the k-th score that the longest candidates give them, over the query's length."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longest = {dim: _Bucket(ids, norms, vectors, dim) for dim, ids, norms, vectors in seeds.value}
        for batch in batches:
            ratio = np.full(batch.num_rows, -np.inf)
            vectors = batch.column("v").to_pylist()
            for row, (query, own) in enumerate(zip(vectors, batch.column("id").to_pylist())):
                bucket, query = longest.get(len(query)), np.array(query, np.int64)
                norm = float(np.sqrt((query.astype(np.float64) ** 2).sum()))
                if bucket is None or norm == 0:
                    continue
                scores = bucket.products(np.flatnonzero(bucket.ids != own), query).astype(np.float64)
                if len(scores) >= k:
                    # Held a little lower, so that rounding never makes a floor too high.
                    least = np.partition(scores, len(scores) - k)[len(scores) - k]
                    ratio[row] = (least - abs(least) * _SLACK) / norm
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("dim"), pa.array(ratio), batch.column("v")], ["id", "dim", "ratio", "v"]
            )

    return work


def _search_cell(k: int, wide: bool):
    """The k best of the cell's candidates for each of its queries."""

    def search(buckets: pa.Table, blocks: pa.Table) -> pa.Table:
        out_query, out_id, out_score = [], [], []
        whole = object if wide else np.int64
        loaded = [
            _Bucket(r["ids"], r["bounds"], r["vectors"], r["dim"])
            for r in sorted(buckets.to_pylist(), key=lambda r: -r["high"])
        ]
        for block in blocks.to_pylist():
            ids, ratios = np.frombuffer(block["block_ids"], np.int64), np.frombuffer(block["block_bounds"], np.float64)
            queries = np.frombuffer(block["block_vectors"], np.int64).reshape(len(ids), -1)
            for own, ratio, query in zip(ids.tolist(), ratios.tolist(), queries):
                norm = float(np.sqrt((query.astype(np.float64) ** 2).sum()))
                floor = ratio * norm if np.isfinite(ratio) else -np.inf
                got_ids, got = np.zeros(0, np.int64), np.zeros(0, whole)
                for bucket in loaded:
                    places = bucket.survivors(query, norm, floor)
                    places = places[bucket.ids[places] != own]
                    if not len(places):
                        continue
                    got_ids = np.concatenate((got_ids, bucket.ids[places]))
                    got = np.concatenate((got, bucket.products(places, query).astype(whole)))
                    best = _best(k, got_ids, got)
                    got_ids, got = got_ids[best], got[best]
                    if len(got) == k:
                        floor = max(floor, float(got[-1]))
                out_query.append(np.full(len(got), own))
                out_id.append(got_ids)
                out_score.append(got)
        ids = {
            name: np.concatenate([np.zeros(0, np.int64), *parts]) for name, parts in (("query_id", out_query), ("id", out_id))
        }
        scores = np.concatenate([np.zeros(0, whole), *out_score])
        if not wide:
            return pa.table({**ids, "score": scores})
        found, mask = scores.tolist(), (1 << _LIMB) - 1
        limbs = {
            "high": [x >> (2 * _LIMB) for x in found], "middle": [(x >> _LIMB) & mask for x in found], "low": [x & mask for x in found]
        }
        return pa.table(
            {**ids, **{c: pa.array(v, pa.int64()) for c, v in limbs.items()}, "text": pa.array([str(x) for x in found], pa.string())}
        )

    return search


def top_products(candidates: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 5) -> DataFrame:
    """(query_id, rank, ``key``, score, score_exact): the ``k`` largest inner products of each query with other rows.

    ``vector`` is an array of whole numbers (see ``quantised``).  Rows whose key
    or vector is null take no part; a query meets vectors of its own dimension
    only, and no row with its own key.  Of equal scores the smaller key comes
    first.  A candidate row that occurs twice counts twice; a key must stand
    for one query vector.  Scores are exact whatever the components: ``score`` is
    null where one does not fit a long, ``score_exact`` has it as text.
    """
    c, q = (_prepared(x, key, vector) for x in (candidates, queries))
    wide = _largest(c) * _largest(q) >= 1 << 62
    buckets = _blocks(c.withColumnRenamed("norm", "bound"), "bound", BUCKET)
    longest = Window.partitionBy("dim").orderBy(F.desc("high"), "block")
    first = buckets.withColumn("n", F.row_number().over(longest)).filter("n = 1")
    # Lengths without a first look start from no floor; they are searched as exactly.
    seen = first.filter(F.octet_length("vectors") <= SEED_BYTES // SEED_LENGTHS)
    seen = seen.orderBy(F.desc(F.octet_length("ids")), "dim").limit(SEED_LENGTHS)
    seeds = [(r.dim, bytes(r.ids), bytes(r.bounds), bytes(r.vectors)) for r in seen.collect()]
    shared = q.sparkSession.sparkContext.broadcast(seeds)
    with_floor = q.dropDuplicates(["id"]).select("id", "dim", "v").mapInArrow(
        _query_floors(shared, k), "id long, dim int, ratio double, v array<long>"
    )
    blocks = _blocks(with_floor.withColumnRenamed("ratio", "bound"), "bound", QUERY_BLOCK)
    # The grid: buckets in cells by length, blocks of queries in cells by the length that they need.
    row = _cells(buckets.select("block", "dim", "high"), "high", "cell_of_buckets")
    column = _cells(blocks.select("block", "dim", "low"), "low", "cell_of_queries")
    needed = column.groupBy("dim", "cell_of_queries").agg(F.min("low").alias("need"))
    reach = row.groupBy("dim", "cell_of_buckets").agg(F.max("high").alias("reach"))
    cells = keep(
        reach.join(needed, "dim").filter(F.col("need") <= F.col("reach") * (1 + _SLACK) + _SLACK)
        .select("dim", "cell_of_buckets", "cell_of_queries")
    )
    left = buckets.join(row.select("dim", "block", "cell_of_buckets"), ["dim", "block"]).join(cells, ["dim", "cell_of_buckets"])
    right = (
        blocks.join(column.select("dim", "block", "cell_of_queries"), ["dim", "block"]).join(cells, ["dim", "cell_of_queries"])
        .select("dim", "cell_of_buckets", "cell_of_queries", "ids", "bounds", "vectors")
        .toDF("q_dim", "q_row", "q_column", "block_ids", "block_bounds", "block_vectors")
    )
    found = left.groupBy("dim", "cell_of_buckets", "cell_of_queries").cogroup(
        right.groupBy("q_dim", "q_row", "q_column")
    ).applyInArrow(_search_cell(k, wide), _WIDE if wide else "query_id long, id long, score long")
    best = [F.desc(c) for c in ("high", "middle", "low")] if wide else [F.desc("score")]
    order = Window.partitionBy("query_id").orderBy(*best, "id")
    text = F.col("text") if wide else F.col("score").cast("string")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", F.col("id").alias(key), text.try_cast("long").alias("score"), text.alias("score_exact")
    )


def _largest(rows: DataFrame) -> int:
    """A bound of the sum of absolute components of all vectors."""
    top = F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))
    return int((rows.agg(F.max(top * F.col("dim"))).first()[0] or 0) * (1 + _SLACK)) + 1


def _prepared(rows: DataFrame, key: str, vector: str) -> DataFrame:
    v = F.col(f"`{vector}`")
    rows = rows.filter(F.col(f"`{key}`").isNotNull() & v.isNotNull() & (F.size(v) > 0))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return rows.select(F.col(f"`{key}`").cast("long").alias("id"), F.size(v).alias("dim"), norm.alias("norm"), v.alias("v"))


def _cells(stats: DataFrame, order: str, name: str) -> DataFrame:
    """A cell number for each block: blocks of like bounds share a cell.  One row per block is ranked."""
    by = Window.partitionBy("dim").orderBy(F.desc(order), "block")
    return stats.withColumn(name, F.floor((F.row_number().over(by) - 1) / _CELL).cast("int"))
