"""Benchmark decontamination with an FM-index per shard of documents.

A shard is a slice of documents inside a task.  Its words become numbers of the
benchmark's vocabulary; runs of known words long enough for a phrase form the
indexed sequence (a phrase cannot reach over an unknown word or a document's
end).  The index has a suffix array by prefix doubling, of which every
``SAMPLED``-th position and the starts of runs are kept, and the
Burrows-Wheeler transform in a wavelet tree.  All test phrases are searched
backward at once; occurrences are located by walking to a sampled position;
the words they cover are merged into spans.

The phrases come in blocks of ``BLOCK_BYTES`` of benchmark text.  One block is
broadcast at a time, so neither driver nor tasks hold more than one; with
several, the result so far is kept in the shared folder between them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.workspace import keep
from .arrow import appended, slices

WINDOW = 10
BLOCK_BYTES = 4 << 20
SAMPLED = 32

# Lower-cases A-Z and turns every byte that is no digit, letter or part of a longer character into a blank.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


class Phrases:
    """The distinct windows of benchmark items: words as numbers from 1, aligned at the end, and their items."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            numbers = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            for k in range(max(1, len(numbers) - window + 1) if numbers else 0):
                found.setdefault(tuple(numbers[k : k + window]), set()).add(item)
        self.items = [sorted(x) for x in found.values()]
        self.sizes = np.array([len(x) for x in found], np.int64)
        self.numbers = np.zeros((len(found), window), np.int32)
        for row, x in zip(self.numbers, found):
            row[window - len(x) :] = x


class FMIndex:
    """Backward search over a sequence of numbers in which 0 separates runs."""

    def __init__(self, sequence: np.ndarray, top: int):
        n = len(sequence)
        self.n, self.bits = n, max(1, int(top).bit_length())
        order = _suffix_array(sequence)
        self.bwt = sequence[order - 1]
        self.before = np.concatenate(([0], np.cumsum(np.bincount(sequence, minlength=top + 1))))
        # The wavelet tree level by level: ones up to each place, and the zeros of the level.
        self.ones, self.zeros = [], []
        left = self.bwt
        for bit in range(self.bits - 1, -1, -1):
            is_one = (left >> bit & 1).astype(bool)
            self.ones.append(np.concatenate(([0], np.cumsum(is_one))).astype(np.int32))
            self.zeros.append(n - int(self.ones[-1][-1]))
            left = np.concatenate((left[~is_one], left[is_one]))
        sampled = (order % SAMPLED == 0) | (sequence[order - 1] == 0)
        self.samples = np.where(sampled, order, -1)

    def step(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Where the suffixes that begin with ``symbols`` and go on before ``places`` start."""
        end, start = places, np.zeros(len(places), np.int64)
        for level in range(self.bits):
            one = (symbols >> (self.bits - 1 - level) & 1).astype(bool)
            ones_end, ones_start = self.ones[level][end], self.ones[level][start]
            end = np.where(one, self.zeros[level] + ones_end, end - ones_end)
            start = np.where(one, self.zeros[level] + ones_start, start - ones_start)
        return self.before[symbols] + end - start

    def search(self, numbers: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases that occur, with the first and last + 1 of their suffixes; ``numbers`` end at the right."""
        which = np.arange(len(numbers))
        low, high = np.zeros(len(numbers), np.int64), np.full(len(numbers), self.n, np.int64)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for back in range(1, numbers.shape[1] + 1):
            symbols = numbers[which, -back]
            low, high = self.step(symbols, low), self.step(symbols, high)
            alive = low < high
            ended = alive & (sizes[which] == back)
            done.append((which[ended], low[ended], high[ended]))
            alive &= ~ended
            which, low, high = which[alive], low[alive], high[alive]
        return tuple(np.concatenate(x) for x in zip(*done))

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the sequence of suffixes given by their place in the order."""
        found, rows, walked = np.zeros(len(rows), np.int64), rows.copy(), np.zeros(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            got = self.samples[rows[open_]]
            hit = got >= 0
            found[open_[hit]] = got[hit] + walked[open_[hit]]
            open_ = open_[~hit]
            rows[open_] = self.step(self.bwt[rows[open_]], rows[open_])
            walked[open_] += 1
        return found


def _suffix_array(sequence: np.ndarray) -> np.ndarray:
    """Order of all suffixes by prefix doubling; separators count as different, the earlier the smaller."""
    apart = sequence == 0
    rank = np.where(apart, np.cumsum(apart) - 1, sequence.astype(np.int64) + apart.sum())
    width = 1
    while True:
        later = np.zeros(len(rank), np.int64)
        later[: len(rank) - width] = rank[width:] + 1
        order = np.lexsort((later, rank))
        changed = (np.diff(rank[order]) != 0) | (np.diff(later[order]) != 0)
        new = np.empty(len(rank), np.int64)
        new[order] = np.concatenate(([0], np.cumsum(changed)))
        if changed.all() or width >= len(rank):
            return order
        rank, width = new, 2 * width


def _indexed(numbers: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of at least ``shortest`` known words, each after a separator, and their places in ``numbers``."""
    known = np.concatenate(([False], numbers > 0, [False]))
    edges = np.flatnonzero(known[1:] != known[:-1])
    starts, ends = edges[::2], edges[1::2]
    long_ = ends - starts >= shortest
    starts, sizes = starts[long_], (ends - starts)[long_] + 1
    at = np.cumsum(sizes) - sizes
    places = np.arange(int(sizes.sum())) - np.repeat(at, sizes) + np.repeat(starts, sizes) - 1
    sequence = numbers[places] if len(places) else np.zeros(0, np.int32)
    sequence[at] = 0
    return sequence, places


def _spans(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], marked.astype(np.int8), [0]))))
    return edges[::2], edges[1::2]


def shard_hits(phrases: Phrases, documents: list[list[bytes]]) -> tuple[list[np.ndarray | None], list[set[str]]]:
    """Per document which words a phrase covers (None: none), and the items whose phrases occur."""
    items: list[set[str]] = [set() for _ in documents]
    covered: list[np.ndarray | None] = [None] * len(documents)
    sizes = np.array([len(x) + 1 for x in documents], np.int64)
    starts = np.cumsum(sizes) - sizes
    numbers = np.zeros(int(sizes.sum()), np.int32)
    for at, words in zip(starts.tolist(), documents):
        numbers[at : at + len(words)] = np.fromiter(map(phrases.vocabulary.get, words, repeat(0)), np.int32, len(words))
    if not len(phrases.sizes):
        return covered, items
    sequence, places = _indexed(numbers, int(phrases.sizes.min()))
    if not len(sequence):
        return covered, items
    index = FMIndex(sequence, len(phrases.vocabulary))
    which, low, high = index.search(phrases.numbers, phrases.sizes)
    count = high - low
    rows = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
    which = np.repeat(which, count)
    at = places[index.locate(rows)]
    change = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + phrases.sizes[which], -1)
    marked = np.cumsum(change) > 0
    doc = np.searchsorted(starts, at, "right") - 1
    for d, w in np.unique(np.stack((doc, which), axis=1), axis=0).tolist():
        items[d].update(phrases.items[w])
        if covered[d] is None:
            covered[d] = marked[starts[d] : starts[d] + sizes[d] - 1]
    return covered, items


_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_FOUND = {"n_words": T.LongType(), "n_hit": T.LongType(), "spans": _SPAN, "items": T.ArrayType(T.StringType())}


def _span_column(spans: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    bounds = np.cumsum([0, *(len(a) for a, _ in spans)])
    ends = [np.concatenate([s[k] for s in spans] or [np.zeros(0)]).astype(np.int32) for k in (0, 1)]
    return pa.ListArray.from_arrays(
        pa.array(bounds, pa.int32()), pa.StructArray.from_arrays([pa.array(x) for x in ends], ["start", "end"])
    )


def find_phrases(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    drop: tuple[str, ...] = (),
    cut: bool = False,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows of ``docs`` with what they share with benchmark ``items``.

    Further columns (others of these names are replaced): ``n_words``, ``n_hit``
    (words inside an occurrence of a window of ``window`` words, or of a whole
    shorter item), ``spans`` (merged, in bytes of the whole UTF-8 text, end
    excluded) and ``items`` (ids as sorted text).  With ``cut`` the spans are
    taken out of the text.  Columns in ``drop`` are left out of the result.

    A null text has no words; an item without words matches nothing; a null
    item id counts as empty text.  Repeated rows are judged each.
    """
    spark = docs.sparkSession
    items = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("id"), F.col(item_text).alias("words"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("words")), F.lit(0))).first()[0]
    n_blocks = max(1, -(-size // block_bytes))
    rows = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in _FOUND))
    block = F.pmod(F.xxhash64("id", "words"), F.lit(n_blocks))
    for b in range(n_blocks):
        phrases = Phrases([(r.id, r.words) for r in items.filter(block == b).collect()], window)
        shared = spark.sparkContext.broadcast(phrases)
        last = b == n_blocks - 1
        schema = T.StructType(
            [f for f in rows.schema.fields if f.name not in _FOUND and not (last and f.name in drop)]
            + [T.StructField(k, v) for k, v in _FOUND.items()]
        )
        rows = rows.mapInArrow(_search(shared, text, drop if last else (), cut and last), schema)
        if n_blocks > 1 and not last:
            rows = keep(rows)
            shared.destroy()
    return rows


def _search(shared, text: str, drop: tuple[str, ...], cut: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = shared.value
        for batch in batches:
            for part in slices(batch, text):
                yield _judged(phrases, part, text, drop, cut)

    return work


def _judged(phrases: Phrases, part: pa.RecordBatch, text: str, drop: tuple[str, ...], cut: bool) -> pa.RecordBatch:
    texts = part.column(text).to_pylist()
    documents = [words_of(x) for x in texts]
    covered, found = shard_hits(phrases, documents)
    if "spans" in part.schema.names:  # what earlier blocks found
        for k, (spans, items) in enumerate(zip(part.column("spans").to_pylist(), part.column("items").to_pylist())):
            found[k].update(items)
            if spans:
                starts, _ = _word_bounds(texts[k])
                marked = covered[k] if covered[k] is not None else np.zeros(len(starts), bool)
                for s in spans:
                    marked |= (starts >= s["start"]) & (starts < s["end"])
                covered[k] = marked
    none = (np.zeros(0, np.int32), np.zeros(0, np.int32))
    spans, left = [none] * len(texts), texts
    for k, marked in enumerate(covered):
        if marked is not None:
            starts, ends = _word_bounds(texts[k])
            first, after = _spans(marked)
            spans[k] = starts[first], ends[after - 1]
    columns = {
        "n_words": pa.array([len(x) for x in documents], pa.int64()),
        "n_hit": pa.array([0 if x is None else int(x.sum()) for x in covered], pa.int64()),
        "spans": _span_column(spans),
        "items": pa.array([sorted(x) for x in found], pa.list_(pa.string())),
    }
    if cut:
        left = [_without(x, *s) for x, s in zip(texts, spans)]
        part = part.set_column(part.schema.get_field_index(text), text, pa.array(left, part.schema.field(text).type))
    return appended(part, [*_FOUND, *drop], **columns)


def _word_bounds(text: str) -> tuple[np.ndarray, np.ndarray]:
    folded = np.frombuffer(text.encode().translate(_FOLD), np.uint8)
    return _spans(folded != 32)


def _without(text: str | None, starts: np.ndarray, ends: np.ndarray) -> str | None:
    if not len(starts):
        return text
    raw = text.encode()
    bounds = [0, *np.stack((starts, ends), axis=1).ravel().tolist(), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(bounds[::2], bounds[1::2])).decode()
