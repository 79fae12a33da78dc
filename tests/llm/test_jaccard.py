import random
from collections import defaultdict

import brute
import numpy as np
import pyarrow as pa
import pytest

from clustervitals.llm import graph, jaccard, queries


def corpus(seed, n=60):
    r = random.Random(seed)
    vocabulary = [f"W{k}" for k in range(400)]
    docs = []
    for k in range(n):
        words = r.choices(vocabulary, k=r.choice([0, 1, 2, 5, 11, 12, 14, 40, 90, 200]))
        docs.append(words)
    for k in range(3 * n):
        words = list(r.choice(docs))
        for _ in range(r.choice([0, 1, 1, 2, 4])):
            if words:
                words[r.randrange(len(words))] = r.choice(vocabulary)
        if r.random() < 0.3:
            words = words[: len(words) - r.choice([0, 1, 2])]
        docs.append(words)
    rows = [(k, r.choice([" ", "\n", "\t "]).join(w)) for k, w in enumerate(docs)]
    return rows + [(900, None), (901, ""), (902, " \n"), (5, rows[9][1]), (7, rows[7][1])]


def compare(spark, rows, **options):
    docs = spark.createDataFrame([(*x, "extra") for x in rows], "doc_id long, text string, component_id string")
    got = defaultdict(lambda: ([], set()))
    for r in jaccard.near_duplicates(docs, **options).collect():
        got[r.doc_id][0].append(r.n_shingles)
        got[r.doc_id][1].add(r.component_id)
    want = brute.jaccard_components(rows)
    assert {d: (sorted(n), c) for d, (n, c) in got.items()} == {d: (n, {c}) for d, (n, c) in want.items()}
    return want


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    want = compare(spark, corpus(seed))
    assert sum(c != d for d, (_, c) in want.items()) > 20


def test_large_spaces_are_cut_by_jobs(spark):
    compare(spark, corpus(3, 30), task_shingles=300, task_documents=6)


def chain(n, size=60):
    """Each text shares with the next only: a long chain of links."""
    words = [f"c{k}" for k in range(n * 2 + size)]
    return [(k, " ".join(words[2 * k : 2 * k + size])) for k in range(n)]


def test_chains_and_dense_groups(spark):
    r = random.Random(4)
    base = [f"b{k}" for k in range(100)]
    dense = []
    for k in range(150):
        words = list(base)
        words[r.randrange(100)] = f"x{k}"
        dense.append((1000 + k, " ".join(words)))
    compare(spark, chain(40) + dense, task_shingles=2000, task_documents=20)


def test_a_dense_region_is_joined_by_shared_shingles(monkeypatch):
    """Sets that pivots cannot part are not compared with every other by pivots of their own."""
    r = np.random.default_rng(7)
    base = np.unique(r.integers(0, 1 << 62, 120).astype(np.uint64))
    sets = []
    for k in range(400):
        own = base.copy()
        own[r.choice(len(own), r.integers(4, 20), replace=False)] = r.integers(0, 1 << 62, 1).astype(np.uint64) + np.uint64(k)
        sets.append(np.unique(own))
    calls, compare_with = [], jaccard._to_pivot
    monkeypatch.setattr(jaccard, "_to_pivot", lambda *x: calls.append(1) or compare_with(*x))
    got = jaccard.join_region(sets)
    known = jaccard._Labels(len(sets))
    for k, s in enumerate(sets):
        for m, t in enumerate(sets[:k]):
            n = len(np.intersect1d(s, t))
            if 100 * n >= 90 * (len(s) + len(t) - n):
                known.join(k, m)
    assert got == [known.find(k) for k in range(len(sets))] and len(set(got)) > 20
    assert len(calls) < 40


def test_spaces_are_parted_by_whole_sets(spark):
    """Documents in one space that differ in nearly all shingles do not meet again."""
    r = np.random.default_rng(9)
    sets = [(0, k, np.unique(r.integers(0, 1 << 62, 100).astype(np.uint64))) for k in range(60)]
    sets += [(s, 100 + k, np.delete(x, [k, k + 20])) for s, k, x in sets[:20]] + [(1, 1000, sets[0][2])]
    rows = spark.createDataFrame([(s, k, len(x), bytearray(x.tobytes())) for s, k, x in sets], "space long, doc long, n long, shingles binary")
    found = {x.doc: x.region for x in jaccard._parted(rows, jaccard.size_classes(100), jaccard.SIMILARITY).collect()}
    assert found == {k + d: k for k in range(20) for d in (0, 100)}


def test_only_likely_rows_move(spark):
    rows = spark.createDataFrame([(k - 500, str(k)) for k in range(4000)] + [(None, "x"), (3, "again")], "doc long, text string")
    wanted = spark.createDataFrame([(k,) for k in range(-500, 3500, 40)], "doc long")
    got = sorted(tuple(x) for x in jaccard._likely(rows, wanted).collect())
    assert {(k, str(k + 500)) for k in range(-500, 3500, 40)} <= set(got) and len(got) < 400


def test_region_join_without_spark():
    rows = [x for x in corpus(6, 40) if x[1]]
    sets = jaccard.shingle_sets(pa.array([t for _, t in rows]))
    first = jaccard.join_region(sets)
    want = brute.jaccard_components([(k, t) for k, (_, t) in enumerate(rows)])
    assert first == [want[k][1] for k in range(len(rows))]
    assert all((s[1:] > s[:-1]).all() for s in sets)


def test_shingles_equal_those_of_plain_sets():
    texts = ["a b c d a b c", "A\tb\x0bc", "a b", "a  b ", "b a", "a", "", None, " \n", "ab c", "a bc", "é É x", "a b c", "x" * 500]
    sets = jaccard.shingle_sets(pa.array([*texts, *texts]).slice(3))
    plain = [brute.shingles(t) for t in [*texts, *texts][3:]]
    for s, p in zip(sets, plain):
        assert len(s) == len(p)
        for t, q in zip(sets, plain):
            assert len(np.intersect1d(s, t)) == len(p & q)


def test_cells_of_equal_blocks():
    classes = jaccard.size_classes(500)
    s = jaccard.shingle_sets(pa.array([" ".join(map(str, range(300)))]))[0]
    one, two = jaccard.cell_keys(s, classes), jaccard.cell_keys(np.delete(s, 7), classes)
    assert len(one) == len(two) and 0 < (one != two).sum() <= 2
    assert len(jaccard.cell_keys(s[:8], classes)) == 0 and len(jaccard.cell_keys(s[:9], classes)) == 2


def test_linked_documents_that_consist_of_common_passages(spark):
    """A passage in most documents counts for no cell; documents of little else are still linked."""
    r = random.Random(12)
    passage = [f"p{k}" for k in range(60)]
    rows = []
    for k in range(150):
        own = [f"d{k}x{j}" for j in range(r.choice([0, 2, 5, 200]))]
        rows.append((k, " ".join(passage + own)))
        if k % 3 == 0:
            rows.append((1000 + k, " ".join(passage + own + ["end"])))
    found = jaccard.common_shingles(spark.createDataFrame(rows, "doc long, text string").select("text"), 3, sum(len(t.split()) - 2 for _, t in rows), 16)
    named = np.unpackbits(found).astype(bool)
    (s,) = jaccard.shingle_sets(pa.array([" ".join(passage)]))
    assert named[jaccard._bucket(s, 16)].all() and named.sum() < 100
    want = compare(spark, rows)
    assert len({c for _, c in want.values()}) < len(want) - 40


def test_documents_that_share_a_cell_meet():
    r = random.Random(8)
    pairs = [(r.randrange(40) * 0x9E3779B97F4A7C15 % (1 << 63), r.randrange(-100, 10**12)) for _ in range(60)]
    rows = []
    for k in range(0, 60, 20):  # dealt by three tasks
        cells, docs = (np.array(x, np.int64) for x in zip(*pairs[k : k + 20]))
        rows += jaccard.deal_cells(cells, docs, 3)
    rows.sort(key=lambda x: x[0])
    batches = [pa.RecordBatch.from_pylist([dict(zip("hcd", x)) for x in rows[k : k + 4]]) for k in range(0, len(rows), 4)]
    found = {d: d for _, d in pairs}
    for batch in jaccard.meet_cells(iter(batches)):
        found.update(zip(*(batch.column(k).to_pylist() for k in range(2))))
    want = {d: d for _, d in pairs}
    for _ in pairs:
        for c, d in pairs:
            want[d] = min(want[d], *(want[e] for b, e in pairs if b == c))
    assert found == want
    assert list(jaccard.deal_cells(np.zeros(0, np.int64), np.zeros(0, np.int64), 3)) == list(jaccard.meet_cells(iter([]))) == []


def test_size_classes_cover_linked_sizes():
    classes = jaccard.size_classes(3000)
    of = {n: c for c, (low, high, _, _) in enumerate(classes) for n in range(low, high + 1)}
    for a in range(9, 2000):
        for b in range(a, a * 10 // 9 + 1):
            assert of[b] - of[a] in (0, 1)
            most = a + b - 2 * (-(-90 * (a + b) // 190))
            assert classes[of[a]][3] > classes[of[a]][2] >= most


def test_components(spark):
    edges = [(k, k + 1) for k in range(200)] + [(500, 400), (400, 450), (7, 7), (1000, None)] + [(2000, 2000 + k) for k in range(1, 50)]
    got = dict(graph.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{k: 0 for k in range(201)}, 400: 400, 450: 400, 500: 400, **{2000 + k: 2000 for k in range(50)}}


def test_empty_table(spark):
    assert jaccard.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_null_key(spark):
    rows = spark.createDataFrame([(None, "a b c d"), (1, "a b c d"), (2, "a b c d")], "doc_id long, text string")
    got = sorted(jaccard.near_duplicates(rows).collect(), key=str)
    assert [(r.doc_id, r.component_id) for r in got] == [(1, 1), (2, 1), (None, None)]


def test_registered_query(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = queries.table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    want = brute.jaccard_components(docs)
    got = queries.QUERIES["op10_jaccard_join"](spark, sf_dir).collect()
    assert {r.doc_id: ([r.n_shingles], r.component_id) for r in got} == want
