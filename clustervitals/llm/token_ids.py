"""Token ids of whole texts, word by word, as the tokenizers library gives them.

Byte-level pre-tokenisation never joins what lies on both sides of certain
places (before a blank that something visible follows, around a line end,
between a letter and a sentence mark).  Texts are cut there, equal words are
encoded by the library once per worker, and the ids of a text are gathered.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import slices, utf8

# Bytes that a worker spends on remembered words, about; beyond them it starts anew.
REMEMBERED_BYTES = 96 << 20
_WORD_BYTES = 150
_TOGETHER = 2000
# Texts encoded together: the more, the fewer words are looked up again.
ENCODED_BYTES = 4 << 20


def _flags(members) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


_BLANK = _flags([*range(9, 14), 32])
# Bytes that may begin white space, in ASCII and beyond (U+0085, U+00A0, U+1680, U+2000 on, U+3000).
_MAYBE_BLANK = _BLANK | _flags([*range(28, 32), 0xC2, 0xE1, 0xE2, 0xE3])
_LETTER = _flags([*range(65, 91), *range(97, 123)])
_MARK = _flags(b",.;:?!")
_VISIBLE = _flags(range(33, 127))
# Letters in two bytes, Latin (but for the two signs among them) and Cyrillic.
_LEAD, _SECOND, _SIGNS = _flags([*range(0xC3, 0xCA), 0xD0, 0xD1]), _flags(range(0x80, 0xC0)), _flags([0x97, 0xB7])


def word_starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where the words of texts laid one after another begin; a word never crosses texts."""
    cut = np.zeros(len(data) + 1, bool)
    if len(data) > 2:
        seen = ~_MAYBE_BLANK[data]
        cut[: len(data) - 1] |= (data[:-1] == 32) & seen[1:]
        cut[1 : len(data)] |= _LETTER[data[:-1]] & _MARK[data[1:]]
        line = (data[1:-1] == 10) & _VISIBLE[data[:-2]] & seen[2:]
        # The last byte of one text and the first of the next are no neighbours, but the text's own cut is there.
        cut[1 : len(data) - 1] |= line
        cut[2 : len(data)] |= line
    # At the end of a text a blank is a word's own end, not the next one's start.
    last = bounds[1:][np.diff(bounds) > 0] - 1
    cut[last[_BLANK[data[last]]]] = False
    cut[bounds] = True
    return np.flatnonzero(cut[: len(data)])


def _byte_letters() -> np.ndarray:
    """The letter that byte-level pre-tokenisation writes for each byte: visible ones stand for themselves."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return np.array([b if b in shown else next(others) for b in range(256)], "<u2")


class _Words:
    """The library's ids of the words met so far."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.letters = _byte_letters()
        self._clear()

    def _clear(self) -> None:
        self.place: dict[bytes, int] = {}
        # A word's ids lie between its bound and the next one.
        self.bounds, self.ids = array("q", [0]), array("I")
        self.bytes = 0

    def _remember(self, words: pa.Array, new: np.ndarray, unknown: list[bytes]) -> None:
        """The ids of ``unknown``, which are the words at the places ``new``."""
        data, bounds = utf8(words)
        alone = letters_only(data, bounds)[new]
        # What the model takes: a letter per byte.
        written = self.letters[data].tobytes().decode("utf-16-le")
        starts, ends = bounds[new].tolist(), bounds[new + 1].tolist()
        tokenize, extend, ids, ends_of = self.model.tokenize, self.ids.extend, self.ids, self.bounds.append
        k = len(self.bounds) - 1
        rest = []
        for word, start, end, plain in zip(unknown, starts, ends, alone.tolist()):
            if plain:
                extend([t.id for t in tokenize(written[start:end])])
                ends_of(len(ids))
                self.place[word] = k
                k += 1
            else:
                rest.append(word)
        for at in range(0, len(rest), _TOGETHER):
            some = rest[at : at + _TOGETHER]
            for word, found in zip(some, self.library.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)):
                extend(found.ids)
                ends_of(len(ids))
                self.place[word] = k
                k += 1
        self.bytes += sum(ends) - sum(starts) + _WORD_BYTES * len(unknown)

    def look_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, size) of each word's ids in the array given third."""
        if self.bytes > REMEMBERED_BYTES:
            self._clear()
        listed = words.to_pylist()
        places = np.fromiter(map(self.place.get, listed, repeat(-1)), np.int64, len(listed))
        new = np.flatnonzero(places < 0)
        if len(new):
            unknown = [listed[k] for k in new.tolist()]
            self._remember(words, new, unknown)
            places[new] = [self.place[w] for w in unknown]
        bounds = np.array(self.bounds, np.int64)
        return bounds[places], bounds[places + 1] - bounds[places], np.array(self.ids, np.uint32)


def letters_only(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which words are letters only, with or without a blank before them: pre-tokenisation leaves those whole."""
    ok = _LETTER[data]
    if len(data) > 1:
        pair = _LEAD[data[:-1]] & _SECOND[data[1:]] & ~((data[:-1] == 0xC3) & _SIGNS[data[1:]])
        ok[:-1] |= pair
        ok[1:] |= pair
    starts, sizes = bounds[:-1], np.diff(bounds)
    blank = np.zeros(len(data), bool)
    blank[starts[sizes > 1]] = True
    ok |= blank & (data == 32)
    bad = np.append(0, np.cumsum(~ok))
    return (sizes > 0) & (bad[bounds[1:]] == bad[bounds[:-1]])


_known: dict[str, _Words] = {}


def _words_of(path: str) -> _Words:
    if path not in _known:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        _known.clear()
        _known[path] = _Words(path)
    return _known[path]


def encode_slice(texts: pa.Array, path: str, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, one after another, and the n + 1 bounds of each text's own."""
    data, bounds = utf8(texts)
    starts = word_starts(data, bounds)
    cuts = np.append(starts, len(data)).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data))]
    ).dictionary_encode()
    begin, size, flat = _words_of(path).look_up(words.dictionary)
    which = words.indices.to_numpy()
    sizes = size[which]
    total = np.append(0, np.cumsum(sizes))
    ids = flat[np.repeat(begin[which] - total[:-1], sizes) + np.arange(total[-1])]
    ends = total[np.searchsorted(starts, bounds)]
    if end_id is None:
        return ids, ends
    return np.insert(ids, ends[1:], np.uint32(end_id)), ends + np.arange(len(ends))


def token_ids(
    docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int | None = None
) -> DataFrame:
    """(``key``, tokens) of every row: the ids as little-endian unsigned 32-bit integers, with ``end_id`` at the end.

    ``tokenizer`` is a tokenizers file with byte-level pre-tokenisation; its added tokens hold no white
    space.  A null text is empty; the order of rows stays.  A word of any length is encoded whole.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", ENCODED_BYTES):
                ids, bounds = encode_slice(part.column("text"), tokenizer, end_id)
                raw = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), part.num_rows, [None, pa.py_buffer(bounds * 4), pa.py_buffer(ids.astype("<u4"))]
                )
                yield pa.RecordBatch.from_arrays([part.column("id"), raw.cast(pa.binary())], ["id", "tokens"])

    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(work, "id long, tokens binary").withColumnRenamed("id", key)
