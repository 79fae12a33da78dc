import random

import brute
import numpy as np
import pytest

from clustervitals.llm import queries, repeats


def corpus(seed):
    r = random.Random(seed)
    alphabet = ["a", "b", "é", "\x00", "t", "x"]

    def noise(n):
        return "".join(r.choices(alphabet, k=n))

    passages = [noise(r.choice([8, 19, 20, 21, 35, 60, 150])) for _ in range(8)]
    docs = []
    for _ in range(60):
        parts = [r.choice([noise(r.randrange(40)), r.choice(passages), "aaaa" * r.randrange(12)]) for _ in range(r.randrange(7))]
        docs.append("".join(parts))
    docs += [r.choice(docs) for _ in range(10)] + [None, "", "ab" * 300, "ab" * 301, "a" * 19, "a" * 20]
    keys = r.sample(range(-50, 500), len(docs))
    return list(zip(keys, docs)) + [(None, passages[6] + "!")]


def run(spark, docs, **options):
    rows = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, place string, kept int")
    found = repeats.remove_repeats(rows, **options)
    assert found.columns == ["doc_id", "text", "place", "n_bytes", "removed", "kept"]
    return found.collect()


@pytest.mark.parametrize("seed,frequent", [(1, 100_000), (2, 100_000), (3, 5)])
def test_equals_brute_force(spark, seed, frequent, monkeypatch):
    monkeypatch.setattr(repeats, "_SAMPLE_HITS", 10)
    docs = corpus(seed)
    want = brute.repeats(docs, 20)
    got = run(spark, docs, length=20, frequent=frequent)
    assert len(got) == len(docs)
    for row in got:
        spans = [(s.start, s.end) for s in row.removed]
        assert (row.n_bytes, spans, bytes(row.kept)) == want[row.doc_id], row.doc_id
    assert sum(bool(r.removed) for r in got) > 20


def test_many_slices_and_ranges(spark, monkeypatch):
    monkeypatch.setattr(repeats, "_SLICE", 300)
    monkeypatch.setattr(repeats, "_RANGE", 500)
    monkeypatch.setattr(repeats, "_CHUNK", 64)
    docs = corpus(4)
    want = brute.repeats(docs, 20)
    for row in run(spark, docs, length=20):
        assert bytes(row.kept) == want[row.doc_id][2]


def test_repeated_rows_are_one_document(spark):
    text = "The quick brown fox jumps over the lazy dog"
    got = run(spark, [(2, text), (2, text), (3, "x" + text)], length=20)
    assert sorted((r.doc_id, len(r.kept)) for r in got) == [(2, len(text)), (2, len(text)), (3, 1)]


def test_empty_table(spark):
    assert run(spark, []) == []


def test_merge_of_runs():
    r = random.Random(7)
    runs = []
    for _ in range(7):
        strings = sorted(bytes(r.choices(b"ab", k=r.randrange(1, 12))) for _ in range(r.randrange(1, 40)))
        shared = [0]
        for a, b in zip(strings, strings[1:]):
            shared.append(next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b))))
        runs.append((strings, shared))
    merged = repeats.merge_runs(runs)
    out = [runs[i][0][k] for i, k, _ in merged]
    assert out == sorted(x for s, _ in runs for x in s)
    for (a, b), (_, _, shared) in zip(zip(out, out[1:]), merged[1:]):
        assert a[:shared] == b[:shared] and (len(a) == shared or len(b) == shared or a[shared] != b[shared])


def test_every_window_has_an_anchor_inside():
    data = np.frombuffer(random.Random(8).randbytes(5000), np.uint8)
    found = repeats.anchors(data, np.array([0, 99, 2000, 5000]), 100)
    covered = sorted(x for a, b in zip(found["first"], found["last"]) for x in range(a, b + 1))
    assert covered == [*range(99, 1901), *range(2000, 4901)]
    assert ((found["at"] >= found["last"]) & (found["at"] + 32 <= found["first"] + 100)).all()


def test_registered_query(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = queries.table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    want = brute.repeats(docs)
    got = queries.QUERIES["op4_repeated_strings"](spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        n, spans, kept = want[r.doc_id]
        removed = sum(b - a for a, b in spans)
        assert (r.n_bytes, r.n_removed, r.n_spans) == (n, removed, len(spans))
        assert r.kept_sha256 == brute.hashlib.sha256(kept).hexdigest()
