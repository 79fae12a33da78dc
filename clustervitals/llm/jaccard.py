"""Exact Jaccard join of word shingle sets in a metric space.

The distance 1 - |x & y| / |x | y| is a metric.  Documents that are within the
radius of each other are found in three steps.

1. Cells.  The shingle universe is cut by hash into more blocks than two
   linked sets of a size class can differ by, so two linked sets agree on at
   least one whole block that is not empty.  Shingles of passages that very many
   documents share, known from counts of all shingles, count for no block.  Documents that share a block of their class or the
   next meet; what is connected through such meetings is a space of its own.  Inside a space the same is done
   again with another hash and with all shingles, which parts what met by chance or by what few shingles were left.
2. Regions.  In a space, pivots are drawn and every document's distance to them
   is computed.  A document belongs to the Voronoi region of its nearest pivot
   and is repeated in the region of any pivot that is less than two radii
   further away: by the triangle inequality linked documents meet in a region.
   A region is cut again by pivots of its own, until it is small.  Documents
   that a pivot has connected already need not be compared with each other,
   and a region in which all are connected is done.  Documents too much alike
   to be cut so meet in blocks, two blocks at a time; in a task, by the documents that hold each shingle.
3. Small regions are joined exactly in a task, by the same recursion.

Spaces of more than ``TASK_SHINGLES`` shingles are cut by Spark jobs, so no task
holds an unbounded group.  Sets are 64-bit hashes of shingles.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.workspace import keep, passing
from .arrow import slices, utf8
from .graph import components, smallest_reachable

SHINGLE = 3
SIMILARITY = (90, 100)
# Largest region joined in one task, in shingles and in documents.
TASK_SHINGLES = 1 << 20
TASK_DOCUMENTS = 2000
# Shingles are counted in so many buckets to find very common ones; one bit of each goes to every task.
BUCKET_BITS = 22
# Cells that a task brings together at a time, about, the least number of such hands a task, and edges that it holds.
HAND_CELLS = 1 << 20
_HANDS = 4
_HELD_EDGES = 1 << 20
_CELL_BYTES = 6
# Pivots that cut a region in one go, in a job and in a task.
JOB_PIVOTS = 12
TASK_PIVOTS = 4
# Regions of so few documents are compared pair by pair.
_PAIRWISE = 8


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


# Lower-cases A-Z; the six bytes that part words become a blank.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
_OF_BYTE = _mixed(np.arange(1, 257, dtype=np.uint64))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts laid one after another, and how many each text has."""
    inside = data != 32
    new = np.zeros(len(data) + 1, bool)
    new[bounds] = True  # a word ends with its text
    starts = np.flatnonzero(inside & (new[:-1] | np.append(True, ~inside[:-1])))
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(bounds) - 1, np.int64)
    ends = np.flatnonzero(inside & (new[1:] | np.append(~inside[1:], True))) + 1
    sizes = ends - starts
    place = np.arange(len(data), dtype=np.int64)[inside] - np.repeat(starts, sizes)
    weights = np.cumprod(np.full(int(sizes.max()), _STEP))
    at = np.cumsum(sizes) - sizes
    hashes = _mixed(np.add.reduceat(_OF_BYTE[data[inside]] * weights[place], at) + sizes.astype(np.uint64))
    return hashes, np.diff(np.searchsorted(starts, bounds))


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words than a shingle make one of all of them."""
    data, bounds = utf8(texts)
    data = np.frombuffer(data.tobytes().translate(_FOLD), np.uint8)
    words, counts = _word_hashes(data, bounds)
    joined = np.full(max(0, len(words) - shingle + 1), shingle, np.uint64)
    for k in range(shingle):
        joined = _mixed(joined * _STEP + words[k : k + len(joined)])
    ends = np.cumsum(counts)
    out = []
    for start, end in zip((ends - counts).tolist(), ends.tolist()):
        if end - start >= shingle:
            found = np.sort(joined[start : end - shingle + 1])
            out.append(found[np.append(True, found[1:] != found[:-1])])
        elif end > start:
            short = np.full(1, end - start, np.uint64)
            for k in range(start, end):
                short = _mixed(short * _STEP + words[k])
            out.append(short)
        else:
            out.append(words[:0])
    return out


def size_classes(largest: int, similarity: tuple[int, int] = SIMILARITY) -> list[tuple[int, int, int, int]]:
    """(smallest size, largest size, differences, blocks) of each class up to ``largest``.

    Two different sets that link have sizes in one class or in two that follow each other; the differences are the
    most that pairs can have whose smaller set is in the class.  There are more blocks than that, so many that a set
    as a rule has more blocks with shingles than differences.
    """
    num, den = similarity
    low, out = -(-num // (den - num)), []
    while low <= largest:
        after = low * den // num + 1
        most = (after - 1) * (den - num) // num
        blocks = most + 1
        while blocks < 2 * most and blocks * (1 - math.exp(-low / blocks)) < most + 1 + 2 * math.sqrt(blocks * math.exp(-low / blocks)):
            blocks += 1
        out.append((low, after - 1, most, blocks))
        low = after
    return out


def common_shingles(rows: DataFrame, shingle: int, total: int, bits: int = BUCKET_BITS) -> np.ndarray:
    """A bit per hash bucket of shingles (of 2^``bits``): whether the bucket holds far more of all ``total`` ones than most.

    Shingles of passages that very many documents share fall there.  Every task counts the buckets of its texts;
    the counts of a range of buckets meet in a task, which returns one bit for each.
    """
    average = total / (1 << bits)
    limit = average + 6 * math.sqrt(average) + 4
    ranges = 1 << max(0, bits - 16)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            for part in slices(batch, "text"):
                found = np.concatenate([*shingle_sets(part.column("text"), shingle), np.zeros(0, np.uint64)])
                counts += np.bincount(_bucket(found, bits), minlength=len(counts)).astype(np.uint32)
        if counts.any():
            parts = [zlib.compress(np.ascontiguousarray(x).tobytes(), 1) for x in np.split(counts, ranges)]
            yield pa.RecordBatch.from_arrays([pa.array(range(ranges), pa.int32()), pa.array(parts, pa.binary())], ["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[part] = sums.get(part, 0) + np.frombuffer(zlib.decompress(raw), np.uint32).astype(np.uint64)
        flags = [np.packbits(x > limit).tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(flags, pa.binary())], ["part", "flags"])

    counted = rows.mapInArrow(count, "part int, counts binary").repartition("part").mapInArrow(add, "part int, flags binary")
    out = np.zeros((ranges, (1 << bits) // ranges), bool)
    for row in passing(counted).collect():
        out[row.part] = np.unpackbits(np.frombuffer(row.flags, np.uint8)).astype(bool)
    return np.packbits(out.ravel())


def _bucket(shingles: np.ndarray, bits: int) -> np.ndarray:
    return (shingles >> np.uint64(64 - bits)).astype(np.int64)


def cell_keys(
    shingles: np.ndarray, classes: list[tuple[int, int, int, int]], common: np.ndarray | None = None
) -> np.ndarray:
    """One key per block, for pairs with the document's class as the smaller one and as the larger one.

    Shingles that ``common`` (a flag per bucket) names count for no block, of no document: what is left of two sets
    differs in no more than the sets do.
    A difference spoils one block at most.  A set with shingles in more blocks than there can be differences agrees
    with a linked one on one of those, so its empty blocks, which many sets share, are no cells.  Where it has fewer,
    its empty blocks are cells too: of two such sets, because there are more blocks than differences.
    """
    if not classes or len(shingles) < classes[0][0]:
        return np.zeros(0, np.int64)
    own = bisect_right(classes, (len(shingles), 1 << 62)) - 1
    if common is not None:
        shingles = shingles[~common[_bucket(shingles, len(common).bit_length() - 1)]]
    mixed, keys = _mixed(shingles), []
    for c in range(max(0, own - 1), own + 1):
        _, _, most, blocks = classes[c]
        block = ((shingles >> np.uint64(20)) % np.uint64(blocks)).astype(np.int64)
        digest = np.zeros(blocks, np.uint64)
        np.add.at(digest, block, mixed)
        key = digest * np.uint64(31) + np.arange(blocks, dtype=np.uint64) + np.uint64(c << 32)
        filled = np.zeros(blocks, bool)
        filled[block] = True
        keys.append(key[filled] if filled.sum() > most else key)
    return _mixed(np.concatenate(keys)).view(np.int64)


def linked(intersection: np.ndarray, union: np.ndarray, similarity: tuple[int, int]) -> np.ndarray:
    return similarity[1] * intersection >= similarity[0] * union


def _to_pivot(pivot: np.ndarray, flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of intersection and union of one set with each of several, given one after another."""
    at = np.minimum(np.searchsorted(pivot, flat), len(pivot) - 1)
    common = np.append(0, np.cumsum(pivot[at] == flat))
    common = common[bounds[1:]] - common[bounds[:-1]]
    return common, np.diff(bounds) + len(pivot) - common


class _Labels:
    """Disjoint sets."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)


def _assigned(distance: np.ndarray, radius: float) -> np.ndarray:
    """Documents x pivots: the nearest pivot, and those less than two radii further away."""
    # The small excess keeps rounding from parting two documents at exactly the radius.
    return distance <= distance.min(axis=1, keepdims=True) + 2 * radius + 1e-9


def join_region(sets: list[np.ndarray], similarity: tuple[int, int] = SIMILARITY, labels: list[int] | None = None) -> list[int]:
    """For each set the index of the first one of its component (given ``labels``: also of those joined already)."""
    radius = 1 - similarity[0] / similarity[1]
    known = _Labels(len(sets))
    first: dict[int, int] = {}
    for k, label in enumerate(labels or []):
        known.join(first.setdefault(label, k), k)
    work = [np.arange(len(sets))]
    while work:
        members = work.pop()
        roots = np.array([known.find(m) for m in members.tolist()])
        if len(members) < 2 or (roots == roots[0]).all():
            continue
        n_pivots = len(members) - 1 if len(members) <= _PAIRWISE else TASK_PIVOTS
        # Pivots from different components first, largest first: small members of a region are settled by them.
        _, kinds = np.unique(roots, return_index=True)
        chosen = (kinds if len(kinds) >= n_pivots else np.unique(np.append(kinds, np.arange(n_pivots))))[:n_pivots]
        flat = np.concatenate([sets[m] for m in members.tolist()])
        bounds = np.append(0, np.cumsum([len(sets[m]) for m in members.tolist()]))
        distance = np.ones((len(members), len(chosen)))
        for k, c in enumerate(chosen.tolist()):
            common, union = _to_pivot(sets[members[c]], flat, bounds)
            distance[:, k] = 1 - common / union
            for m in members[linked(common, union, similarity)].tolist():
                known.join(int(members[c]), m)
        rest = np.ones(len(members), bool)
        rest[chosen] = False  # a pivot has been compared with all
        near = _assigned(distance, radius)[rest]
        if near.sum() > 1.5 * rest.sum():
            _join_all(members[rest], sets, similarity, known)
        else:
            work += [members[rest][near[:, k]] for k in range(len(chosen))]
    return [known.find(k) for k in range(len(sets))]


def _join_all(members: np.ndarray, sets: list[np.ndarray], similarity: tuple[int, int], known: _Labels) -> None:
    """Join all linked members: each set is counted against the holders of its shingles."""
    sizes = np.array([len(sets[m]) for m in members.tolist()])
    shingles, ids = np.unique(np.concatenate([sets[m] for m in members.tolist()]), return_inverse=True)
    counts = np.bincount(ids, minlength=len(shingles))
    starts = np.cumsum(counts) - counts
    holders = np.repeat(np.arange(len(members)), sizes)[np.argsort(ids, kind="stable")]
    bounds = np.append(0, np.cumsum(sizes))
    labels = np.array([known.find(m) for m in members.tolist()])
    for k in range(len(members)):
        if (labels == labels[0]).all():
            return
        own = ids[bounds[k] : bounds[k + 1]]
        own = own[counts[own] > 1]
        n = counts[own]
        held = np.arange(n.sum()) + np.repeat(starts[own] - np.cumsum(n) + n, n)
        common = np.bincount(holders[held], minlength=len(members))
        hit = linked(common, sizes[k] + sizes - common, similarity) & (labels != labels[k])
        for other in np.unique(labels[hit]).tolist():
            known.join(int(labels[k]), other)
            labels[(labels == labels[k]) | (labels == other)] = known.find(other)


def _shingled(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{key}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text"))


def _map_sets(rows: DataFrame, shingle: int, schema: str, emit) -> DataFrame:
    """``emit`` makes columns of the documents' numbers and sets, slice by slice."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text"), shingle)
                yield pa.RecordBatch.from_pydict(emit(part, sets))

    return rows.mapInArrow(work, schema)


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    similarity: tuple[int, int] = SIMILARITY,
    task_shingles: int = TASK_SHINGLES,
    task_documents: int = TASK_DOCUMENTS,
) -> DataFrame:
    """(``key``, n_shingles, component_id) for every row: the size of its set and its component's smallest key.

    A null or empty text has the empty set and no link.  Rows with the same key
    are one document of several texts.  A row with a null key links with nothing
    and its component is null.  ``key`` must be an integer column.
    """
    rows = _shingled(docs, key, text)
    members = keep(
        _map_sets(
            rows, shingle, "doc long, n long, same binary",
            lambda part, sets: {
                "doc": part.column("doc"),
                "n": pa.array([len(s) for s in sets], pa.int64()),
                "same": pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
            },
        )
    )
    # Equal sets: all but the one with the smallest key are linked to it and then left out.
    first = keep(members.filter("n > 0 and doc is not null").groupBy("same").agg(F.min("doc").alias("first"), F.max("n").alias("n")))
    copies = members.filter("n > 0 and doc is not null").join(first.select("same", "first"), "same").filter("doc <> first")
    links = copies.select(F.col("doc").alias("a"), F.col("first").alias("b"))
    largest = first.agg(F.max("n")).first()[0] or 0
    spaces = _spaces(rows, members, shingle, size_classes(largest, similarity), similarity)
    if spaces is not None:
        distinct = first.select(F.col("first").alias("doc")).distinct()
        spaces = keep(spaces.join(distinct, "doc", "left_semi"))
        sets = keep(
            _map_sets(
                _likely(rows, spaces).join(spaces, "doc"), shingle, "space long, doc long, n long, shingles binary",
                lambda part, sets: {
                    "space": part.column("space"),
                    "doc": part.column("doc"),
                    "n": pa.array([len(s) for s in sets], pa.int64()),
                    "shingles": pa.array([s.tobytes() for s in sets], pa.binary()),
                },
            )
        )
        regions = _parted(sets, size_classes(largest, similarity), similarity)
        sets = sets.join(regions, "doc").select("region", "doc", "n", "shingles")
        links = links.union(_joined(sets, similarity, task_shingles, task_documents))
    found = components(links)
    return (
        members.join(found, members["doc"] == found["node"], "left")
        .select(
            members["doc"].alias(key),
            members["n"].alias("n_shingles"),
            F.coalesce(found["component"], members["doc"]).alias("component_id"),
        )
    )


def _planes(x: np.ndarray, width: int = 8) -> bytes:
    """The low ``width`` bytes of 64-bit numbers, first bytes first: equal high bytes lie together."""
    return x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _numbers(raw: bytes, width: int = 8) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, -1).T
    return out.view(np.int64)[:, 0]


def deal_cells(cells: np.ndarray, docs: np.ndarray, hands: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(hand, cells, docs) of the documents' cells: one row for all that one hand gets from here.

    Of the documents with the same cell only the smallest goes out; the others are its neighbours already, and
    such edges go out without cells.
    """
    order = np.lexsort((docs, cells))
    cells, docs = cells[order], docs[order]
    new = np.ones(len(cells), bool)
    new[1:] = cells[1:] != cells[:-1]
    least = docs[new][np.cumsum(new) - 1]
    apart = least != docs
    if apart.any():
        a, b = smallest_reachable(docs[apart], least[apart])
        yield int(b.min() % hands), b"", _planes(np.concatenate((a, b)))
    cells, docs = cells[new].view(np.uint64), docs[new]
    hand = (cells >> np.uint64(32)) % np.uint64(hands)
    order = np.argsort(hand, kind="stable")
    hand, cells, docs = hand[order], cells[order].view(np.int64), docs[order]
    cuts = np.flatnonzero(np.append(True, hand[1:] != hand[:-1])) if len(hand) else np.zeros(0, np.int64)
    for start, end in zip(cuts.tolist(), [*cuts[1:].tolist(), len(hand)]):
        yield int(hand[start]), _planes(cells[start:end], _CELL_BYTES), _planes(docs[start:end])


def meet_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars of the documents that share a cell, from rows sorted by hand."""
    edges: list[tuple[np.ndarray, np.ndarray]] = []
    held: list[tuple[np.ndarray, np.ndarray]] = []
    hand = None

    def settle() -> None:
        cells, docs = (np.concatenate(x) for x in zip(*held))
        held.clear()
        order = np.lexsort((docs, cells))
        cells, docs = cells[order], docs[order]
        new = np.append(True, cells[1:] != cells[:-1])
        least = docs[new][np.cumsum(new) - 1]
        apart = least != docs
        edges.append((docs[apart], least[apart]))
        if sum(len(a) for a, _ in edges) > _HELD_EDGES:
            edges[:] = [smallest_reachable(*(np.concatenate(x) for x in zip(*edges)))]

    for batch in batches:
        for h, cells, docs in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if h != hand and held:
                settle()
            hand, ids = h, _numbers(docs)
            if cells:
                held.append((_numbers(cells, _CELL_BYTES), ids))
            else:
                edges.append((ids[: len(ids) // 2], ids[len(ids) // 2 :]))
    if held:
        settle()
    if edges:
        nodes, roots = smallest_reachable(*(np.concatenate(x) for x in zip(*edges)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], ["a", "b"])


def _place(key: str, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.col(key).cast("long")), 64 - bits)


def _bitmaps(keys: DataFrame, key: str) -> tuple[int, DataFrame]:
    """How many bits of a key's hash name its place, and the bitmaps (bucket, bitmap) of all places: 16 to 32 bits a key."""
    bits = max(16, (32 * keys.count()).bit_length() - 1)
    # Bitmaps count from 1; one has 2^15 bits.
    place = _place(key, bits) + 1
    return bits, keys.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bitmap")
    )


def parted(rows: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose ``key`` may be in ``keys`` (all that are, and few others), and the other rows.

    So only the first ones move to a join with the keys.  A bitmap of the keys' hashes goes to every task.
    """
    bits, found = _bitmaps(keys, key)
    place = _place(key, bits) + 1
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("_bitmap", (at / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    marked = (
        rows.withColumn("_bucket", F.bitmap_bucket_number(place))
        .join(F.broadcast(found.toDF("_bucket", "_bitmap")), "_bucket", "left")
        .withColumn("_likely", F.coalesce(F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1, F.lit(False)))
    )
    return marked.filter("_likely").select(*rows.columns), marked.filter("not _likely").select(*rows.columns)


def _likely(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of the wanted documents and few others, so that only their texts move to a join.

    A bit per hash of a document goes to every task, 16 to 32 bits for each wanted one.
    """
    bits, found = _bitmaps(wanted, "doc")
    place = _place("doc", bits)
    named = np.zeros((1 << bits) >> 3, np.uint8)
    for row in passing(found).collect():
        at = (row.bucket - 1) << 12
        named[at : at + len(row.bitmap)] = np.frombuffer(row.bitmap, np.uint8)
    shared = rows.sparkSession.sparkContext.broadcast(named)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("place").to_numpy()
            bit = shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1
            yield batch.filter(pa.array(bit.astype(bool))).select(["doc", "text"])

    return rows.filter("doc is not null").withColumn("place", place).mapInArrow(choose, "doc long, text string")


def _hands(sets: DataFrame, similarity: tuple[int, int], tasks: int) -> int:
    """How many hands all cells of the sets (n: their sizes) are dealt to."""
    num, den = similarity
    sums = sets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("shingles"), F.count("*").alias("docs")).first()
    return max(_HANDS * tasks, (sums.shingles * 2 * (den - num) // num + 4 * sums.docs) // HAND_CELLS)


def _dealt(keys: list[np.ndarray], docs: pa.Array, hands: int) -> pa.RecordBatch:
    docs = np.repeat(docs.to_numpy(zero_copy_only=False).astype(np.int64), [len(k) for k in keys])
    dealt = list(deal_cells(np.concatenate([*keys, np.zeros(0, np.int64)]), docs, hands))
    columns = list(zip(*dealt)) or [(), (), ()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.binary()))], ["hand", "cells", "docs"]
    )


def _met(dealt: DataFrame, tasks: int) -> DataFrame:
    """(node, component) of documents that share a cell with another one."""
    met = dealt.repartition(tasks, "hand").sortWithinPartitions("hand").mapInArrow(meet_cells, "a long, b long")
    return components(met, stars=True)


_DEALT = "hand int, cells binary, docs binary"


def _parted(sets: DataFrame, classes: list[tuple[int, int, int, int]], similarity: tuple[int, int]) -> DataFrame:
    """(doc, region) of documents that share a cell of their whole sets, under another hash, with one of their space."""
    tasks = sets.sparkSession.sparkContext.defaultParallelism
    hands = _hands(sets, similarity, tasks)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for space, raw in zip(batch.column("space").to_pylist(), batch.column("shingles").to_pylist()):
                own = cell_keys(_mixed(np.frombuffer(raw, np.uint64) + _STEP), classes).view(np.uint64)
                keys.append(_mixed(own * np.uint64(31) + np.uint64(space & (1 << 64) - 1)).view(np.int64))
            yield _dealt(keys, batch.column("doc"), hands)

    return _met(sets.mapInArrow(deal, _DEALT), tasks).toDF("doc", "region")


def _spaces(rows: DataFrame, members: DataFrame, shingle: int, classes: list[tuple[int, int, int, int]], similarity) -> DataFrame | None:
    """(doc, space) of documents that share a cell with another one.

    Cells move once, packed by the task that they go to, six bytes each: cells that agree in those by chance only
    make a space larger.
    """
    if not classes:
        return None
    # As many tasks as cores, for each of them repeats a document that shares cells; its hands come one after another.
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    hands = _hands(members, similarity, tasks)
    total = members.agg(F.sum("n")).first()[0]
    shared = rows.sparkSession.sparkContext.broadcast(common_shingles(rows, shingle, total))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            for part in slices(batch, "text"):
                keys = [cell_keys(s, classes, common) for s in shingle_sets(part.column("text"), shingle)]
                yield _dealt(keys, part.column("doc"), hands)

    return _met(rows.filter("doc is not null").mapInArrow(deal, _DEALT), tasks).toDF("doc", "space")


def _joined(sets: DataFrame, similarity: tuple[int, int], task_shingles: int, task_documents: int) -> DataFrame:
    """Links (a, b) that connect all linked documents of each space."""
    sets = keep(sets.withColumn("label", F.col("doc")))
    links = None
    while True:
        sizes = keep(
            sets.groupBy("region")
            .agg(
                F.sum("n").alias("shingles"), F.count("*").alias("docs"), F.min("label").alias("l"), F.max("label").alias("h")
            )
            .filter("l <> h")
            .select(
                "region",
                ((F.col("shingles") > task_shingles) | (F.col("docs") > task_documents)).alias("large"),
                # Two chunks make a small region.
                F.ceil(2 * F.greatest(F.col("shingles") / task_shingles, F.col("docs") / task_documents)).alias("chunks"),
            )
        )
        small = sets.join(sizes.filter("not large").select("region"), "region")
        # Kept, so that no task runs the workers of the next step beside those of this one.
        new = keep(small.groupBy("region").applyInPandas(_join_in_task(similarity), "a long, b long"))
        links = new if links is None else links.union(new)
        if sizes.filter("large").isEmpty():
            return links
        # Few enough for every task: a large region has very many documents or shingles.
        large = sets.join(F.broadcast(sizes.filter("large").select("region", "chunks")), "region")
        judged = keep(_to_pivots(large, similarity))
        links = links.union(judged.select(F.explode("linked").alias("a"), F.col("doc").alias("b")))
        # A region is cut by its pivots where that repeats few documents.  Else its documents, too much alike
        # for that, meet block by block: every two blocks of a region make a small one.
        spread = judged.groupBy("region").agg((F.sum(F.size("near")) <= 1.5 * F.count("*")).alias("cut"))
        block = F.pmod(F.xxhash64("doc", "region"), F.col("chunks"))
        others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda k: k != block)
        pairs = F.transform(others, lambda k: -1 - (F.least(k, block) * F.col("chunks") + F.greatest(k, block)))
        parts = judged.filter("not pivot").join(spread, "region").withColumn(
            "part", F.explode(F.when(F.col("cut"), F.col("near")).otherwise(pairs))
        )
        sets = keep(parts.select(F.xxhash64("region", "part").alias("region"), "doc", "n", "shingles", "label"))


def _to_pivots(large: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Rows of large regions with the pivots they link with, the regions they go to, and new labels.

    A region is dealt out in chunks, each of which gets the region's pivots.
    Equal labels mean that documents are connected; a chunk joins the labels of
    pivots that one of its documents links with.
    """
    radius = 1 - similarity[0] / similarity[1]
    order = Window.partitionBy("region").orderBy(F.xxhash64("doc", "region"), "doc")
    drawn = (
        large.select("region", "chunks", "doc").withColumn("k", F.row_number().over(order)).filter(F.col("k") <= JOB_PIVOTS)
    )
    pivots = (
        large.select("region", "doc", "shingles").join(F.broadcast(drawn), ["region", "doc"])
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("region", "chunk", "k", "doc", "shingles").toDF("in_region", "in_chunk", "k", "pivot", "pivot_shingles")
    )
    dealt = large.withColumn("chunk", F.pmod(F.xxhash64("doc"), F.col("chunks")))

    def judge(rows: pa.Table, own: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x, np.uint64) for x in rows.column("shingles").to_pylist()]
        flat = np.concatenate([*sets, np.zeros(0, np.uint64)])  # a chunk can be empty
        bounds = np.append(0, np.cumsum([len(s) for s in sets])).astype(np.int64)
        own = own.sort_by("k")
        ids = own.column("pivot").to_numpy()
        distance, hit = np.ones((len(sets), len(ids))), np.zeros((len(sets), len(ids)), bool)
        for k, x in enumerate(own.column("pivot_shingles").to_pylist()):
            common, union = _to_pivot(np.frombuffer(x, np.uint64), flat, bounds)
            distance[:, k], hit[:, k] = 1 - common / union, linked(common, union, similarity)
        near = _assigned(distance, radius)
        joined = _Labels(len(ids))
        for h in np.unique(hit, axis=0):
            to = np.flatnonzero(h).tolist()
            for k in to[1:]:
                joined.join(to[0], k)
        root = ids[[joined.find(k) for k in range(len(ids))]] if len(ids) else ids
        label = rows.column("label").to_numpy()
        return pa.table({
            **{c: rows.column(c) for c in ("region", "chunks", "doc", "n", "shingles")},
            "label": np.where(hit.any(axis=1), root[hit.argmax(axis=1)], label) if len(ids) else label,
            "linked": pa.array([ids[h].tolist() for h in hit], pa.list_(pa.int64())),
            "near": pa.array([np.flatnonzero(x).tolist() for x in near], pa.list_(pa.int64())),
            "pivot": pa.array(np.isin(rows.column("doc").to_numpy(), ids)),
        })

    schema = (
        "region long, chunks long, doc long, n long, shingles binary, label long, "
        "linked array<long>, near array<long>, pivot boolean"
    )
    with_own = dealt.groupBy("region", "chunk").cogroup(pivots.groupBy("in_region", "in_chunk"))
    return with_own.applyInArrow(judge, schema)


def _join_in_task(similarity: tuple[int, int]):
    def join(region: pd.DataFrame) -> pd.DataFrame:
        region = region.sort_values("doc", kind="stable")
        docs = region["doc"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in region["shingles"]]
        first = docs[join_region(sets, similarity, region["label"].tolist())]
        return pd.DataFrame({"a": docs, "b": first})[docs != first]

    return join
