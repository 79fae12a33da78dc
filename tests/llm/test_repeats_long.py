"""Long texts in which nearly every byte, or every line, repeats."""

import random
import tracemalloc

import brute
import numpy as np
import pyarrow as pa
import pytest

from clustervitals.llm import repeats

R = random.Random(31)
LINE = "".join(R.choice("abcdefghij ") for _ in range(80)) + "\n"
PADDING = [c * n for n in range(95, 400, 3) for c in "ab"]


def runs_of(texts, wanted_all=True):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    bounds = np.cumsum([0, *(len(t.encode()) for t in texts)])
    lists = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        own = [x["at"] for x in repeats.anchor_blocks(data[a:b], np.array([0, b - a]))]
        lists.append(np.concatenate([*own, np.zeros(0, np.int64)]).astype(np.int32))
    offsets = np.cumsum([0, *map(len, lists)]).astype(np.int32)
    wanted = repeats._Wanted(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists))))
    place = np.arange(len(texts), dtype=np.int64)
    return repeats._slice_runs(data, bounds, place, place, wanted, np.zeros(0, np.int64), 100, 3)


@pytest.mark.parametrize("texts", [["a" * (6 << 20)], [LINE * ((6 << 20) // 81)], PADDING * 80], ids=["one character", "one line", "padding"])
def test_memory_does_not_grow_with_the_text(texts):
    tracemalloc.start()
    kept = sum(batch.nbytes for batch in runs_of(texts))
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    size = sum(map(len, texts))
    assert peak < 250e6 + 20 * size and kept < 4 * size


def test_blocks_find_the_same_anchors(monkeypatch):
    text = "".join(R.choice("ab") for _ in range(3000)) + "a" * 3000
    data, bounds = np.frombuffer(text.encode(), np.uint8), np.array([0, 500, 6000])
    whole = repeats.anchors(data, bounds)
    monkeypatch.setattr(repeats, "_BLOCK", 7)
    blocks = list(repeats.anchor_blocks(data, bounds))
    assert len(blocks) > 100 and all(len(b["at"]) <= 7 + 7 for b in blocks)
    for name, values in whole.items():
        assert (np.concatenate([b[name] for b in blocks]) == values).all()


def test_touching_intervals_are_one():
    doc, first, last = np.array([1, 0, 0, 0, 1]), np.array([5, 7, 0, 3, 9]), np.array([8, 9, 2, 5, 9])
    ids = np.array([10, 11])
    found = repeats._settled(doc, first, last, ids, ids)
    assert found["place"].to_pylist() == [10, 11] and found["marks"].to_pylist() == [[0, 5, 7, 9], [5, 9]]
    assert len(repeats._settled(doc[:0], first[:0], last[:0], ids, ids)["marks"]) == 0


def test_long_texts_equal_brute_force(spark):
    rows = [(1, "a" * 400_000), (2, LINE * 3000), (3, "b" * 50_000 + LINE + "a" * 50_000), (4, None), (5, "")]
    rows += [(10 + k, t) for k, t in enumerate(PADDING)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, removed string")
    want = brute.repeats(rows)
    for r in repeats.remove_repeats(docs).collect():
        n, spans, kept = want[r.doc_id]
        assert r.n_bytes == n and [tuple(s) for s in r.removed] == spans and bytes(r.kept) == kept
