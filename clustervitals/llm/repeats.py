"""Removal of repeated byte strings by a distributed, common-prefix-aware merge sort of suffixes.

A byte goes if a string of ``LENGTH`` bytes covers it that also starts earlier,
in a document with a smaller key or further left in the same document.

1. Of texts that occur several times only the first takes part in the sort;
   the others are repeated from end to end.
2. Suffixes are sorted where they can matter.  Every window of ``LENGTH`` bytes
   names one of its short substrings as its anchor (the leftmost with the least
   hash), so equal windows have equal anchors.  Windows of an anchor that occurs
   once are unique, and the suffix at an anchor stands for all windows that name
   it, about 35.
3. A task sorts the suffixes at its repeated anchors, each with as many bytes as
   its windows reach to the right and, reversed, to the left.  Of equal ones the
   first stays, the others are settled.  The rest goes out as sorted runs, one
   for each range of anchor hashes, with front coding: the length of the prefix
   shared with the one before, and what follows.
4. The runs of a range are merged by a loser tree that knows for every candidate
   how long a prefix it shares with the last winner, and compares from there.
   The common prefixes of neighbours in the merged order tell which windows are
   equal on the right; those that are also equal on the left (by a 64-bit hash)
   are repeats of the first of them.

The windows of very frequent anchors are sorted as suffixes of their own, dealt
out by all their bytes, so that one anchor does not fill a range.  Which anchors
are frequent is estimated on a sample; that decides where windows meet, never
which are repeats.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.workspace import keep
from .arrow import slices, utf8

LENGTH = 100
# An anchor is frequent from so many occurrences on, or from one in so many bytes of text.
FREQUENT = 100_000
_FREQUENT_SHIFT = 24
# Occurrences of a frequent anchor that the sample should hold.
_SAMPLE_HITS = 200
# Text handled together in a task, and text per range of the merge, in bytes.
_SLICE = 4 << 20
_RANGE = 16 << 20
# Windows whose anchors are looked for together, and anchors, or suffixes, that are handled together.
_CHUNK = 1 << 20
_BLOCK = 1 << 17

_FIRST_PLACE = -(1 << 63)
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _anchor_size(length: int) -> int:
    return 1 << max(0, (length // 3).bit_length() - 1)


def _hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes from each place; ``size`` is a power of two."""
    h = _mixed(data.astype(np.uint64) + np.uint64(1))
    width, factor = 1, int(_PRIME)
    while width < size:
        h = h[:-width] * np.uint64(factor) + h[width:]
        width, factor = 2 * width, factor * factor & (1 << 64) - 1
    return _mixed(h)


def anchor_blocks(
    data: np.ndarray, bounds: np.ndarray, length: int = LENGTH, most: int = 0
) -> Iterator[dict[str, np.ndarray]]:
    """The anchors of all windows inside the texts laid one after another in ``data``, about ``most`` at a time.

    ``at`` is the anchor's place, ``first`` and ``last`` the starts of the first
    and last of its windows, ``hash`` that of its bytes.  An anchor whose windows
    fall into two blocks is in both, with its own windows each.
    """
    most = most or _BLOCK
    size = _anchor_size(length)
    reach = length - size + 1
    inside = np.zeros(len(data) + 1, np.int8)
    fits = np.diff(bounds) >= length
    np.add.at(inside, bounds[:-1][fits], 1)
    np.add.at(inside, bounds[1:][fits] - length + 1, -1)
    np.cumsum(inside, dtype=np.int8, out=inside)
    held: list[dict[str, np.ndarray]] = []
    n = 0
    for begin in range(0, max(0, len(data) - length + 1), _CHUNK):
        starts = np.flatnonzero(inside[begin : min(begin + _CHUNK, len(data) - length + 1)])
        if not len(starts):
            continue
        hashes = _hashes(data[begin : begin + _CHUNK + length - 1], size)
        least, at, width = hashes, np.arange(len(hashes), dtype=np.int32), 1
        while width < reach:
            step = min(width, reach - width)
            left = least[:-step] <= least[step:]
            least, at = np.where(left, least[:-step], least[step:]), np.where(left, at[:-step], at[step:])
            width += step
        at = at[starts]
        change = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        end = np.append(change[1:], len(at)) - 1
        found = {
            "at": at[change].astype(np.int64) + begin, "first": starts[change] + begin, "last": starts[end] + begin,
            "hash": hashes[at[change]].view(np.int64),
        }
        # Where nearly every byte is an anchor a chunk makes several blocks; else several chunks make one.
        for k in range(0, len(change), most):
            held.append({name: x[k : k + most] for name, x in found.items()})
            n += len(held[-1]["at"])
            if n >= most:
                yield {name: np.concatenate([x[name] for x in held]) for name in found}
                held, n = [], 0
    if held:
        yield {name: np.concatenate([x[name] for x in held]) for name in held[0]}


def anchors(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH) -> dict[str, np.ndarray]:
    """All anchors at once (see ``anchor_blocks``)."""
    blocks = list(anchor_blocks(data, bounds, length))
    return {k: np.concatenate([*(x[k] for x in blocks), np.zeros(0, np.int64)]) for k in ("at", "first", "last", "hash")}


class Run:
    """Sorted strings with front coding, and for each its windows and places.

    ``shared`` is the length of the prefix shared with the string before.  A
    string has ``right`` bytes from the anchor on and ``left`` bytes before it,
    reversed; its windows start ``low`` to ``high`` bytes before the anchor.
    """

    def __init__(self, tails: bytes, fields: dict[str, np.ndarray]):
        self.tails, self.fields = tails, fields

    def pack(self) -> bytes:
        return zlib.compress(pickle.dumps((self.tails, self.fields), protocol=5), 1)

    @staticmethod
    def unpack(packed: bytes) -> Run:
        return Run(*pickle.loads(zlib.decompress(packed)))

    def strings(self) -> list[bytes]:
        out, before, at = [], b"", 0
        for shared, size in zip(self.fields["shared"].tolist(), self.fields["size"].tolist()):
            before = before[:shared] + self.tails[at : at + size - shared]
            at += size - shared
            out.append(before)
        return out


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> list[tuple[int, int, int]]:
    """(run, place in it, prefix shared with the one before) of all strings of sorted runs, in order.

    Each run is given as its strings and the prefixes they share with the one
    before.  A loser tree keeps for every candidate its prefix shared with the
    last winner: of two candidates the one that shares more is smaller, and only
    if both share the same do they get compared, from there on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    done = object()
    at = [0] * k
    text: list = [runs[i][0][0] if i < len(runs) and runs[i][0] else done for i in range(k)]
    shared = [0] * k

    def beats(x: int, y: int) -> bool:
        """Whether candidate x comes before y; the later one learns its prefix shared with the other."""
        a, b = text[x], text[y]
        if b is done:
            return True
        if a is done:
            return False
        p, q = shared[x], shared[y]
        if p != q:
            return p > q
        n = min(len(a), len(b))
        differ = int.from_bytes(a[p:n], "big") ^ int.from_bytes(b[p:n], "big")
        common = n - (differ.bit_length() + 7) // 8 if differ else n
        if common == n:
            first = (len(a), x) < (len(b), y)
        else:
            first = a[common] < b[common]
        shared[y if first else x] = common
        return first

    loser = [0] * k

    def play(node: int) -> int:
        if node >= k:
            return node - k
        x, y = play(2 * node), play(2 * node + 1)
        won = beats(x, y)
        loser[node] = y if won else x
        return x if won else y

    winner = play(1) if k > 1 else 0
    out = []
    while text[winner] is not done:
        out.append((winner, at[winner], shared[winner]))
        at[winner] += 1
        strings, prefixes = runs[winner]
        if at[winner] < len(strings):
            text[winner], shared[winner] = strings[at[winner]], prefixes[at[winner]]
        else:
            text[winner] = done
        node = (winner + k) // 2
        while node:
            if beats(loser[node], winner):
                loser[node], winner = winner, loser[node]
            node //= 2
    return out


def repeated_windows(strings: list[bytes], shared: np.ndarray, fields: dict[str, np.ndarray], length: int) -> np.ndarray:
    """Strings x offsets: whether the window that starts so many bytes before the anchor is a repeat."""
    low, high, right = fields["low"], fields["high"], fields["right"]
    order = np.lexsort((fields["at"], fields["tag"], fields["place"]))
    new = _changes(*(fields[name][order] for name in ("place", "tag", "at")))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    most = int(high.max(initial=0))
    lefts = np.zeros((len(strings), most), np.uint8)
    for row, x, r in zip(lefts, strings, right.tolist()):
        row[: len(x) - r] = np.frombuffer(x, np.uint8, len(x) - r, r)
    out = np.zeros((len(strings), most + 1), bool)
    before = np.zeros(len(strings), np.uint64)
    for offset in range(most + 1):
        if offset:
            before = _mixed(before * _PRIME + lefts[:, offset - 1] + np.uint64(1))
        own = np.flatnonzero((low <= offset) & (offset <= high))
        if len(own) < 2:
            continue
        equal_right = np.cumsum(shared < length - offset)[own]
        order = np.lexsort((rank[own], before[own], equal_right))
        own, equal_right = own[order], equal_right[order]
        starts = np.flatnonzero(
            np.append(True, (equal_right[1:] != equal_right[:-1]) | (before[own][1:] != before[own][:-1]))
        )
        earliest = np.repeat(rank[own][starts], np.diff(np.append(starts, len(own))))
        out[own, offset] = rank[own] > earliest
    return out


def _settled(doc: np.ndarray, first: np.ndarray, last: np.ndarray, place, tag) -> dict[str, pa.Array]:
    """Intervals of window starts by document, as pairs one after another; those that touch are one."""
    order = np.lexsort((first, doc))
    doc, first, last = (x[order].astype(np.int64) for x in (doc, first, last))
    reach = np.maximum.accumulate((doc << 32) + last) if len(doc) else last
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] << 32) + first[1:] > reach[:-1] + 1
    new[1:] |= doc[1:] != doc[:-1]
    at = np.flatnonzero(new)
    end = np.append(at[1:], len(new))[: len(at)] - 1
    doc, first, last = doc[at], first[at], reach[end] - (doc[at] << 32)
    pairs = np.stack((first, last), axis=1).ravel().astype(np.int32)
    starts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
    bounds = pa.array(2 * np.append(starts, len(doc)), pa.int32())
    return {
        "place": pa.array(place[doc[starts]]), "tag": pa.array(tag[doc[starts]]),
        "marks": pa.ListArray.from_arrays(bounds, pa.array(pairs)),
    }


class _Wanted:
    """Which anchors of a slice are wanted, from a list of places per document."""

    def __init__(self, lists: pa.ListArray):
        sizes = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy()
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.places = lists.flatten().to_numpy().copy()
        for a, b in zip(self.starts.tolist(), self.ends.tolist()):
            self.places[a:b].sort()

    def __call__(self, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
        """For anchors in ascending order, so that a document's lie together."""
        out = np.zeros(len(doc), bool)
        cuts = np.flatnonzero(_changes(doc)).tolist()
        for a, b in zip(cuts, [*cuts[1:], len(doc)]):
            own = self.places[self.starts[doc[a]] : self.ends[doc[a]]]
            if len(own):
                k = np.minimum(np.searchsorted(own, at[a:b]), len(own) - 1)
                out[a:b] = own[k] == at[a:b]
        return out


def _suffixes(data, bounds, place, tag, found, hot, length):
    """Strings at the anchors found, or of each window of the hot ones, as rows of bytes, and their fields."""
    doc = np.searchsorted(bounds, found["at"], "right") - 1
    cold = ~hot
    first, last, centre, to = (found[k][cold] for k in ("first", "last", "at", "hash"))
    doc_of = doc[cold]
    if hot.any():
        counts = (found["last"] - found["first"] + 1)[hot]
        before = np.repeat(np.cumsum(counts) - counts, counts)
        each = np.arange(int(counts.sum())) - before + np.repeat(found["first"][hot], counts)
        whole = np.zeros(len(each), np.uint64)
        for k in range(length):
            whole = _mixed(whole * _PRIME + data[each + k] + np.uint64(1))
        first, last, centre = (np.concatenate((x, each)) for x in (first, last, centre))
        to, doc_of = np.concatenate((to, whole.view(np.int64))), np.append(doc_of, np.repeat(doc[hot], counts))
    low, high = centre - last, centre - first
    right, size = length - low, length - low + high
    rows = np.zeros((len(centre), int(size.max(initial=1))), np.uint8)
    c = np.arange(rows.shape[1])[None, :]
    for block in range(0, len(centre), 1 << 13):
        part = slice(block, block + (1 << 13))
        r, n, o = right[part, None], size[part, None], centre[part, None]
        source = np.where(c < r, o + c, o - 1 - (c - r))
        rows[part] = np.where(c < n, data[np.clip(source, 0, len(data) - 1)], 0)
    fields = {
        "to": to.view(np.uint64), "size": size, "right": right, "low": low, "high": high, "doc": doc_of,
        "at": centre - bounds[doc_of], "place": place[doc_of], "tag": tag[doc_of],
    }
    return rows, fields


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before in any column; the first one does."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    return new


def _slice_runs(data, bounds, place, tag, wanted, frequent, length, n_ranges) -> Iterator[pa.RecordBatch]:
    """The sorted runs of a slice, block by block: a block holds a bounded number of suffixes."""
    for found in anchor_blocks(data, bounds, length):
        doc = np.searchsorted(bounds, found["at"], "right") - 1
        chosen = wanted(doc, found["at"] - bounds[doc])
        found = {k: x[chosen] for k, x in found.items()}
        hot = np.isin(found["hash"], frequent)
        rows = np.cumsum(np.where(hot, found["last"] - found["first"] + 1, 1))
        cuts = np.flatnonzero(np.diff(rows // _BLOCK)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(hot)]):
            if b > a:
                yield _block_runs(data, bounds, place, tag, {k: x[a:b] for k, x in found.items()}, hot[a:b], length, n_ranges)


def _block_runs(data, bounds, place, tag, found, hot, length, n_ranges) -> pa.RecordBatch:
    """The sorted runs of a block by range, and the intervals that are settled here."""
    rows, f = _suffixes(data, bounds, place, tag, found, hot, length)
    f["to"] = (f["to"] % np.uint64(n_ranges)).astype(np.int64)
    string = np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel()
    order = np.lexsort((f["at"], f["tag"], f["place"], f["high"], f["low"], f["size"], string, f["to"]))
    rows, f = rows[order], {k: v[order] for k, v in f.items()}
    differ = rows[1:] != rows[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1]) if len(rows) else np.zeros(0, np.int64)
    new = _changes(f["to"], f["size"], f["low"], f["high"])
    new[1:] |= common < rows.shape[1]
    head = np.flatnonzero(new)[np.cumsum(new) - 1] if len(rows) else np.zeros(0, np.int64)
    # The same place twice (a repeated row, or windows met twice) is no repeat.
    later = (f["place"] != f["place"][head]) | (f["tag"] != f["tag"][head]) | (f["at"] != f["at"][head])
    settled = _settled(f["doc"][later], (f["at"] - f["high"])[later], (f["at"] - f["low"])[later], place, tag)
    common = np.append(0, np.minimum(common, np.minimum(f["size"][1:], f["size"][:-1])))
    common = common[new]  # equal ones between do not shorten it: they share all with the one before
    rows, f = rows[new], {k: v[new] for k, v in f.items()}
    edge = _changes(f["to"])
    common = np.where(edge, 0, common[: len(edge)])
    c = np.arange(rows.shape[1])[None, :]
    tails = rows[(c >= common[:, None]) & (c < f["size"][:, None])].tobytes()
    ends = np.append(0, np.cumsum(f["size"] - common)).tolist()
    starts = np.flatnonzero(edge).tolist()
    runs = []
    for a, b in zip(starts, [*starts[1:], len(edge)]):
        small = {k: f[k][a:b].astype(np.uint8) for k in ("size", "right", "low", "high")}
        fields = small | {"shared": common[a:b].astype(np.uint8), "at": f["at"][a:b].astype(np.int32)}
        runs.append(Run(tails[ends[a] : ends[b]], fields | {k: f[k][a:b] for k in ("place", "tag")}).pack())
    n, m = len(runs), len(settled["place"])
    keys = np.concatenate((f["to"][starts] if starts else np.zeros(0, np.int64), settled["tag"].to_numpy() % n_ranges))
    nothing = pa.nulls(n, pa.int64())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(keys, pa.int64()),
            pa.array([*runs, *[None] * m], pa.binary()),
            pa.concat_arrays([nothing, settled["place"].cast(pa.int64())]),
            pa.concat_arrays([nothing, settled["tag"].cast(pa.int64())]),
            pa.concat_arrays([pa.nulls(n, settled["marks"].type), settled["marks"]]),
        ],
        ["range", "run", "place", "tag", "marks"],
    )


def _merge_range(length: int):
    """Merge the runs of a range; gives intervals of repeated window starts by document."""

    def merge(table: pa.Table) -> pa.Table:
        settled = table.filter(pa.compute.is_valid(table.column("place"))).select(["place", "tag", "marks"])
        runs = [Run.unpack(x) for x in table.column("run").drop_null().to_pylist()]
        if not runs:
            return settled
        strings = [r.strings() for r in runs]
        merged = np.array(merge_runs([(s, r.fields["shared"].tolist()) for s, r in zip(strings, runs)]), np.int64)
        offset = np.cumsum([0, *map(len, strings)])
        order = offset[merged[:, 0]] + merged[:, 1]
        fields = {
            k: np.concatenate([r.fields[k] for r in runs])[order].astype(np.int64)
            for k in ("right", "low", "high", "place", "tag", "at")
        }
        flat = [x for s in strings for x in s]
        found = repeated_windows([flat[i] for i in order.tolist()], merged[:, 2], fields, length)
        edge = np.diff(np.pad(found.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        which, near = np.nonzero(edge == 1)
        far = np.nonzero(edge == -1)[1] - 1
        key = np.lexsort((fields["tag"], fields["place"]))
        doc = np.empty(len(key), np.int64)
        doc[key] = np.cumsum(_changes(fields["place"][key], fields["tag"][key])) - 1
        heads = key[_changes(fields["place"][key], fields["tag"][key])]
        at = fields["at"][which]
        own = _settled(doc[which], at - far, at - near, fields["place"][heads], fields["tag"][heads])
        return pa.concat_tables([settled, pa.table(own).cast(settled.schema)])

    return merge


def _frequent(rows: DataFrame, total: int, length: int, frequent: int) -> np.ndarray:
    """Hashes of anchors that occur more than about ``frequent`` times, from a sample of the texts."""
    limit = max(frequent, total >> _FREQUENT_SHIFT)
    step = max(1, limit // _SAMPLE_HITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                for found in anchor_blocks(*utf8(part.column("text")), length):
                    hashes, counts = np.unique(found["hash"], return_counts=True)
                    yield pa.RecordBatch.from_pydict({"hash": hashes, "n": counts})

    sample = rows.filter(F.pmod("tag", F.lit(step)) == 0).select("text").mapInArrow(count, "hash long, n long")
    found = sample.groupBy("hash").agg(F.sum("n").alias("n")).filter(F.col("n") * step > limit).select("hash")
    return np.array(sorted(r.hash for r in found.collect()), np.int64)


def remove_repeats(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    frequent: int = FREQUENT,
    drop: tuple[str, ...] = (),
    cut: bool = False,
) -> DataFrame:
    """The rows of ``docs`` with what is left of each text.

    Further columns (others of these names are replaced): ``n_bytes`` of the
    whole text, ``removed`` (maximal spans of bytes, end excluded) and ``kept``,
    the remaining bytes; the spans can cut characters.  With ``cut`` the text is
    what is left, without the rest of cut characters, and ``kept`` is null.
    Columns in ``drop`` are left out.  ``length`` is 12 to 127.

    A null text counts as empty.  ``key`` must be an integer column; a null key
    comes before all others.  Of different texts with one key the order is that
    of a hash; rows with equal key and text are one document.
    """
    if not 12 <= length <= 127:
        raise ValueError("length must be 12 to 127")
    made = ("n_bytes", "removed", "kept")
    plain = [c for c in docs.columns if c not in made]
    place = F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(_FIRST_PLACE))
    body = F.col(f"`{text}`")
    # The text moves once; the other columns go with it in a struct, so their names do not matter.
    carried = [c for c in plain if c not in drop and c != text]
    rows = docs.select(
        F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in carried)).alias("row"),
        place.alias("place"), F.xxhash64(F.coalesce(body, F.lit(""))).alias("tag"), body.alias("text"),
    )
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_ranges = total // _RANGE + 1
    shared = docs.sparkSession.sparkContext.broadcast(_frequent(rows, total, length, frequent))
    # Kept, like the wanted anchors below: the texts and anchors moved to find them are off the disk before the runs are made.
    firsts = keep(
        rows.groupBy(F.unhex(F.md5("text")).alias("same")).agg(F.min(F.struct("place", "tag")).alias("first"))
        .select(F.col("first.place").alias("place"), F.col("first.tag").alias("tag"), F.lit(True).alias("is_first"))
        .distinct()
    )
    rows = rows.join(firsts, ["place", "tag"], "left")

    def first_occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per block and anchor hash its first place and count; further places under keys of their own."""
        for batch in batches:
            batch = batch.filter(pa.compute.fill_null(batch.column("is_first"), False))
            for part in slices(batch, "text", _SLICE):
                data, bounds = utf8(part.column("text"))
                for found in anchor_blocks(data, bounds, length):
                    yield first_of_block(part, bounds, found)

    def first_of_block(part: pa.RecordBatch, bounds: np.ndarray, found: dict[str, np.ndarray]) -> pa.RecordBatch:
        _, head, counts = np.unique(found["hash"], return_index=True, return_counts=True)
        doc = np.searchsorted(bounds, found["at"], "right") - 1
        of_hash = np.searchsorted(found["hash"][head], found["hash"])
        further = np.ones(len(doc), bool)
        further[head] = False
        place, tag = (part.column(c).to_numpy()[doc] for c in ("place", "tag"))
        spread = _mixed(tag.view(np.uint64) * _PRIME + found["at"].view(np.uint64)).view(np.int64)
        return pa.RecordBatch.from_pydict({
            "hash": np.where(further, spread, found["hash"]),
            "place": place, "tag": tag,
            "at": (found["at"] - bounds[doc]).astype(np.int32),
            "n": counts[of_hash].astype(np.int32),
        })

    seen = rows.mapInArrow(first_occurrences, "hash long, place long, tag long, at int, n int")
    repeated = seen.withColumn("n", F.sum("n").over(Window.partitionBy("hash"))).filter("n > 1")
    wanted = keep(repeated.groupBy("place", "tag").agg(F.collect_list("at").alias("wanted")))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                data, bounds = utf8(part.column("text"))
                place, tag = (part.column(c).to_numpy() for c in ("place", "tag"))
                yield from _slice_runs(data, bounds, place, tag, _Wanted(part.column("wanted")), shared.value, length, n_ranges)

    sent = rows.join(wanted, ["place", "tag"]).mapInArrow(
        runs, "range long, run binary, place long, tag long, marks array<int>"
    )
    settled = sent.groupBy("range").applyInArrow(_merge_range(length), "place long, tag long, marks array<int>")
    marks = settled.groupBy("place", "tag").agg(F.flatten(F.collect_list("marks")).alias("marks"))
    result = rows.join(marks, ["place", "tag"], "left")
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = T.StructType([
        T.StructField("row", rows.schema["row"].dataType), T.StructField("text", T.StringType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("removed", span), T.StructField("kept", T.BinaryType()),
    ])

    def take_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                data, bounds = utf8(part.column("text"))
                yield _kept(part, data.tobytes(), bounds, length, text not in drop, cut)

    taken = result.mapInArrow(take_out, schema)
    columns = [F.col("text").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in plain if c not in drop]
    return taken.select(*columns, "n_bytes", "removed", "kept")


def _kept(
    part: pa.RecordBatch, data: bytes, bounds: np.ndarray, length: int, with_text: bool, cut: bool
) -> pa.RecordBatch:
    starts, ends, counts, left = [], [], [], []
    is_first, marks = part.column("is_first").to_pylist(), part.column("marks")
    bounds = bounds.tolist()
    for k in range(part.num_rows):
        raw = data[bounds[k] : bounds[k + 1]]
        if not is_first[k]:
            spans = np.array([[0, len(raw)]] if len(raw) >= length else np.zeros((0, 2)), np.int64)
        elif marks[k].is_valid:
            found = marks[k].values.to_numpy().reshape(-1, 2).astype(np.int64)
            found = found[np.argsort(found[:, 0])]
            reach = np.maximum.accumulate(found[:, 1] + length)
            new = np.append(True, found[1:, 0] > reach[:-1])
            spans = np.stack((found[new, 0], reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)]), axis=1)
        else:
            spans = np.zeros((0, 2), np.int64)
        edges = [0, *spans.ravel().tolist(), len(raw)]
        left.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
        starts.append(spans[:, 0])
        ends.append(spans[:, 1])
        counts.append(len(spans))
    removed = pa.ListArray.from_arrays(
        pa.array(np.cumsum([0, *counts]), pa.int32()),
        pa.StructArray.from_arrays(
            [pa.array(np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int32)) for x in (starts, ends)], ["start", "end"]
        ),
    )
    text = part.column("text") if with_text else pa.nulls(part.num_rows, pa.string())
    kept = pa.array(left, pa.binary())
    if cut:
        whole = [x.decode("utf-8", "ignore") if n else x.decode() for x, n in zip(left, counts)]
        text = pa.array(whole, pa.string(), mask=~part.column("text").is_valid().to_numpy(False))
        kept = pa.nulls(len(left), pa.binary())
    return pa.RecordBatch.from_arrays(
        [part.column("row"), text, pa.array(np.diff(bounds), pa.int64()), removed, kept],
        ["row", "text", "n_bytes", "removed", "kept"],
    )
