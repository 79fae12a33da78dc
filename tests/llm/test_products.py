import random
import struct

import brute
import pytest
from pyspark.sql import functions as F

from clustervitals.llm import products, queries


def vectors(seed, n=400, dim=8):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        size = r.choice([0.01, 0.3, 1, 1, 2, 5])
        rows.append((k, [r.gauss(0, 1) * size for _ in range(dim)]))
    rows += [(n + k, rows[k][1]) for k in range(40)]
    return rows + [
        (1000, None), (1050, [float("nan")] * dim), (1100, [None] * dim), (1150, [float("inf")] * dim), (1200, [0.0] * dim),
        (1250, [1.0, 2.0]), (1300, [2.0, 1.0]), (1350, []), (None, [1.0] * dim), (1400, [1e30] + [0.0] * (dim - 1)),
    ]


def run(spark, rows, k=5):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    whole = df.select("vec_id", products.quantised("embedding").alias("v"), F.lit(1).alias("score"))
    found = products.top_products(whole, whole.filter("vec_id % 50 = 0"), "vec_id", "v", k)
    assert found.columns == ["query_id", "rank", "vec_id", "score", "score_exact"]
    rows = found.collect()
    assert all(r.score == (int(r.score_exact) if abs(int(r.score_exact)) < 2**63 else None) for r in rows)
    return sorted((r.query_id, r.rank, r.vec_id, int(r.score_exact)) for r in rows)


@pytest.mark.parametrize("seed,bucket", [(1, 1024), (2, 16), (3, 7)])
def test_equals_brute_force(spark, seed, bucket, monkeypatch):
    monkeypatch.setattr(products, "BUCKET", bucket)
    monkeypatch.setattr(products, "QUERY_BLOCK", 3)
    rows = vectors(seed)
    assert run(spark, rows) == brute.top_products(rows)


def test_large_components_are_scored_exactly(spark):
    rows = [(0, [1.0, 0.0]), (1, [300000.0, 0.0]), (2, [400000.0, 0.0])]
    assert run(spark, rows) == [(0, 1, 2, 26214400000), (0, 2, 1, 19660800000)] == brute.top_products(rows)
    r = random.Random(9)
    for top in (2e5, 3e5, 1e12, 3.0e16):
        rows = [(k, [float(r.randrange(-1000, 1000)) * top / 1000 for _ in range(3)]) for k in range(120)]
        rows = [(k, [struct.unpack("f", struct.pack("f", x))[0] for x in v]) for k, v in rows]
        assert run(spark, rows) == brute.top_products(rows)


def test_lengths_without_a_first_look(spark, monkeypatch):
    monkeypatch.setattr(products, "SEED_LENGTHS", 1)
    r = random.Random(10)
    rows = [(k, [r.gauss(0, 1) for _ in range(1 + k % 5)]) for k in range(300)]
    assert run(spark, [(k, [round(x * 256) / 256 for x in v]) for k, v in rows]) == brute.top_products([(k, [round(x * 256) / 256 for x in v]) for k, v in rows])


def test_fewer_than_k_and_empty(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [-1.0, 0.0])]
    assert run(spark, rows) == [(0, 1, 1, 65536), (0, 2, 2, -65536)]
    assert run(spark, []) == []


def test_repeated_candidates_count_each(spark):
    assert run(spark, [(50, [1.0]), (50, [1.0]), (3, [2.0]), (3, [2.0])]) == [(50, 1, 3, 131072), (50, 2, 3, 131072)]


def test_registered_query_equals_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in queries.table(spark, sf_dir, "embeddings").select("vec_id", "embedding").collect()]
    assert sorted(tuple(r) for r in queries.QUERIES["op7_top_products"](spark, sf_dir).collect()) == brute.top_products(rows)
