"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The distinct words of a slice of texts lie in one flat array of symbols.  In a
round every word finds its best pair by a segmented minimum of merge ranks; all
occurrences of that pair in the word merge from the left at once, and the array
is compacted.  Rounds go on until no word has a pair left.

Merging several occurrences at once equals merging one at a time unless the new
symbol can form, with a neighbour, a piece that ranks before the pair itself.
Such pieces are found from the vocabulary, and of their pairs one occurrence is
merged in a round.

Words are cut where no piece of the vocabulary can span: before a blank mark
that follows another character, if no piece holds such a place, and, in long
words, between two characters that are side by side in no piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrow import appended, slices, strings

BLANK = "▁"
# Texts encoded together in a task, in bytes.
_SLICE = 1 << 20
# Distinct words whose ids a task remembers, emptied when full.
_REMEMBERED = 200_000
# Words longer than this are also cut between characters that no piece joins.
_LONG_WORD = 32
_NO_RANK = np.int32(1 << 30)


class Vocabulary:
    """Merge ranks, ids and surfaces of the pieces of a model, given as the bytes of its file."""

    def __init__(self, model_bytes: bytes):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes)
        n = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        if model.decode(model.encode(" a  b ")) != " a  b " or not model.id_to_piece(model.encode("a")[0]).startswith(BLANK):
            raise ValueError("only models that keep blanks and put one before the text are supported")
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        normal = [
            i for i in range(n)
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) and pieces[i]
        ]
        by_score = sorted(normal, key=lambda i: (-model.get_score(i), i))
        rank = {pieces[i]: r for r, i in enumerate(by_score)}
        # Symbols: every piece, then characters that occur only inside pieces.
        symbols = {pieces[i]: k for k, i in enumerate(normal)}
        for ch in sorted({ch for i in normal for ch in pieces[i]}):
            symbols.setdefault(ch, len(symbols))
        self.symbols = symbols
        self.ids = np.full(len(symbols), -1, np.int64)
        self.ids[: len(normal)] = normal
        self.surface = list(symbols)
        pairs: dict[int, int] = {}
        ahead = set()
        for piece, r in rank.items():
            for k in range(1, len(piece)):
                left, right = piece[:k], piece[k:]
                if left in symbols and right in symbols:
                    pairs[symbols[left] << 32 | symbols[right]] = r
                    ahead.update(symbols[x] for x in (left, right) if len(x) > 1 and rank[x] > r)
        self._hash_pairs(pairs)
        # By rank: the symbol a merge makes, and whether it must be made one at a time.
        self.by_rank = np.array([symbols[pieces[i]] for i in by_score], np.int32)
        self.alone = np.isin(self.by_rank, np.array(sorted(ahead), np.int64))
        self.inner_blank = any(BLANK in p.lstrip(BLANK) for p in rank)
        self.joined = {p[k : k + 2] for p in rank for k in range(len(p) - 1)}
        first = np.array(sorted(ord(c) for c in symbols if len(c) == 1), np.int32)
        self.points = np.array([ord(c) if len(c) == 1 else 0 for c in symbols], np.int64)
        self.chars, self.char_symbols = first, np.array([symbols[chr(c)] for c in first.tolist()], np.int32)

    def _hash_pairs(self, pairs: dict[int, int]) -> None:
        """A hash table with open addresses, so that a look-up is one or two array reads."""
        bits = max(4, (4 * len(pairs)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.rank = np.full(1 << bits, _NO_RANK, np.int32)
        wanted = np.array(list(pairs), np.int64)
        for key, slot in zip(pairs, self._slots(wanted).tolist()):
            while self.keys[slot] >= 0:
                slot = (slot + 1) & self.mask
            self.keys[slot], self.rank[slot] = key, pairs[key]

    def _slots(self, wanted: np.ndarray) -> np.ndarray:
        return ((wanted.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair of symbols; unknown characters are negative and merge with nothing."""
        wanted = left.astype(np.int64) << 32 | right
        slots = self._slots(wanted)
        found = self.keys[slots]
        out = np.where(found == wanted, self.rank[slots], _NO_RANK)
        open_ = np.flatnonzero((found != wanted) & (found >= 0))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & self.mask
            found = self.keys[slots[open_]]
            hit = found == wanted[open_]
            out[open_[hit]] = self.rank[slots[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        out[(left < 0) | (right < 0)] = _NO_RANK
        return out

    def cut(self, word: str) -> list[str]:
        """The word in parts over whose bounds no piece can reach."""
        if len(word) <= _LONG_WORD:
            return [word]
        bounds = [0, *(i for i in range(1, len(word)) if word[i - 1 : i + 1] not in self.joined), len(word)]
        return [word[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


def merge_rounds(vocabulary: Vocabulary, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all words after the last round, and the word of each symbol.

    A character outside the vocabulary is -1 - its code point.
    """
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.int32)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    at = np.minimum(np.searchsorted(vocabulary.chars, points), max(len(vocabulary.chars) - 1, 0))
    known = vocabulary.chars[at] == points if len(vocabulary.chars) else np.zeros(len(points), bool)
    symbols = np.where(known, vocabulary.char_symbols[at], -1 - points) if len(points) else points
    word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    done_symbols, done_words = [], []
    rank = np.full(len(symbols), _NO_RANK, np.int32)
    if len(symbols) > 1:
        rank[:-1] = np.where(word[1:] == word[:-1], vocabulary.ranks(symbols[:-1], symbols[1:]), _NO_RANK)
    while len(symbols):
        starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        least = np.minimum.reduceat(rank, starts)
        lengths = np.diff(np.append(starts, len(symbols)))
        active = np.repeat(least < _NO_RANK, lengths)
        if not active.all():
            done_symbols.append(symbols[~active])
            done_words.append(word[~active])
            symbols, word, rank = symbols[active], word[active], rank[active]
            lengths, least = lengths[least < _NO_RANK], least[least < _NO_RANK]
            starts = np.cumsum(lengths) - lengths
        if not len(symbols):
            break
        best = np.repeat(least, lengths)
        hits = np.flatnonzero(rank == best)
        # Overlapping occurrences are side by side; every other one of such a run counts.
        run_starts = np.append(True, np.diff(hits) != 1)
        run = np.flatnonzero(run_starts)
        place = np.arange(len(hits)) - np.repeat(run, np.diff(np.append(run, len(hits))))
        first_of_word = np.append(True, word[hits[1:]] != word[hits[:-1]])
        take = (place % 2 == 0) & (~vocabulary.alone[best[hits]] | first_of_word)
        hits = hits[take]
        symbols[hits] = vocabulary.by_rank[best[hits]]
        kept = np.ones(len(symbols), bool)
        kept[hits + 1] = False
        hits -= np.arange(len(hits))
        symbols, word, rank = symbols[kept], word[kept], rank[kept]
        # Only pairs that touch a new symbol have another rank now.
        pairs = np.concatenate((hits, hits[hits > 0] - 1))
        rank[pairs] = _NO_RANK
        pairs = pairs[pairs + 1 < len(symbols)]
        pairs = pairs[word[pairs] == word[pairs + 1]]
        rank[pairs] = vocabulary.ranks(symbols[pairs], symbols[pairs + 1])
    if not done_symbols:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    all_symbols, all_words = np.concatenate(done_symbols), np.concatenate(done_words)
    order = np.argsort(all_words, kind="stable")
    return all_symbols[order], all_words[order]


class Encoder:
    """Ids and decoded text of whole texts; remembers the words it has met."""

    def __init__(self, model_bytes: bytes):
        self.vocabulary = Vocabulary(model_bytes)
        v = self.vocabulary
        top = int(max(v.ids.max(initial=0), v.byte_ids.max()))
        # What an id adds to the decoded bytes; ids that stand for nothing add nothing.
        self.surface = [b""] * (top + 1)
        for symbol, i in enumerate(v.ids.tolist()):
            if i >= 0:
                self.surface[i] = v.surface[symbol].replace(BLANK, " ").encode()
        for b, i in enumerate(v.byte_ids.tolist()):
            self.surface[i] = bytes([b])
        sizes = np.fromiter(map(len, self.surface), np.int32, top + 1)
        self.spelled = np.frombuffer(b"".join(self.surface), np.uint8)
        self.spelled_at, self.spelled_size = np.cumsum(sizes, dtype=np.int32) - sizes, sizes
        # Ids of the words met, as the bytes of 32-bit integers.
        self.known: dict[str, bytes] = {}

    def _flat_ids(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all symbols in order, and how many each has: a character without a piece has one per byte."""
        v = self.vocabulary
        own = np.where(symbols >= 0, v.ids[np.maximum(symbols, 0)], -1)
        missing = own < 0
        if not missing.any():
            return own, np.ones(len(own), np.int64)
        points = np.where(symbols < 0, -1 - symbols, v.points[np.maximum(symbols, 0)])[missing]
        sizes = np.ones(len(own), np.int64)
        sizes[missing] = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        flat = np.repeat(own, sizes)
        raw = points.astype("<u4").tobytes().decode("utf-32-le", "replace").encode()
        flat[np.repeat(missing, sizes)] = v.byte_ids[np.frombuffer(raw, np.uint8)]
        return flat, sizes

    def _bytes(self, ids: list[int]) -> bytes:
        return b"".join([self.surface[i] for i in ids])

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the blank put before a text is dropped again."""
        return self._bytes(ids).decode("utf-8", "replace").removeprefix(" ")

    def learn(self, words: list[str]) -> None:
        """Encode words not met before."""
        parts, owner = [], []
        for k, word in enumerate(words):
            cut = self.vocabulary.cut(word)
            parts += cut
            owner += [k] * len(cut)
        symbols, of = merge_rounds(self.vocabulary, parts)
        ids, sizes = self._flat_ids(symbols)
        symbol_bounds = np.searchsorted(np.array(owner, np.int64)[of], np.arange(len(words) + 1))
        bounds = np.append(0, np.cumsum(sizes))[symbol_bounds]
        packed = ids.astype(np.int32).tobytes()
        at = (4 * bounds).tolist()
        self.known.update(zip(words, [packed[i:j] for i, j in zip(at[:-1], at[1:])]))

    def words(self, text: str) -> list[str]:
        """A text with its blank marks, cut before each mark that follows another character."""
        marked = BLANK + text.replace(" ", BLANK)
        if self.vocabulary.inner_blank:
            return [marked]
        found = marked.split(BLANK)
        if "" not in found[1:]:
            return [BLANK + part for part in found[1:]]
        out, blanks = [], 0
        for part in found[1:]:
            blanks += 1
            if part:
                out.append(BLANK * blanks + part)
                blanks = 0
        return out + [BLANK * blanks] * (blanks > 0)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as the bytes of 32-bit integers."""
        split = [self.words(x) if x else [] for x in texts]
        if len(self.known) > _REMEMBERED:
            self.known.clear()
        unmet = list(set(chain.from_iterable(split)).difference(self.known))
        if unmet:
            self.learn(unmet)
        return [b"".join(map(self.known.__getitem__, ws)) for ws in split]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of several texts, given their ids one after another, and the bounds of the texts.

        The blank put before a text is dropped again.
        """
        sizes = self.spelled_size[ids]
        starts = self.spelled_at[ids]
        first = bounds[:-1][np.diff(bounds) > 0]
        blank = (sizes[first] > 0) & (self.spelled[np.minimum(starts[first], len(self.spelled) - 1)] == 32)
        sizes[first] -= blank
        starts[first] += blank
        ends = np.cumsum(sizes, dtype=np.int64)
        take = np.repeat((starts - ends + sizes).astype(np.int32), sizes)
        take += np.arange(len(take), dtype=np.int32)
        return self.spelled[take], np.append(0, ends)[bounds]


def encode_decode(
    docs: DataFrame, model_path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded"
) -> DataFrame:
    """The rows of ``docs`` with the ids of every whole text and the text that the ids decode to.

    ``model_path`` must be readable by the driver; its bytes are sent to the
    tasks.  A null text counts as empty and has no ids.  Columns named like the
    two new ones are replaced.  Only BPE models with byte fallback and without
    text normalisation are supported.
    """
    rows = docs.select(*(c for c in docs.columns if c not in (ids, decoded)))
    schema = T.StructType(
        [*rows.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())]
    )
    with open(model_path, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Made anew in every task, so that an idle worker holds no words.
        encoder = Encoder(shared.value)
        for batch in batches:
            for part in slices(batch, text, _SLICE):
                packed = encoder.encode([x or "" for x in part.column(text).to_pylist()])
                bounds = np.cumsum([0, *(len(x) // 4 for x in packed)], dtype=np.int64)
                values = np.frombuffer(b"".join(packed), np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values))
                yield appended(part, [], **{ids: lists, decoded: strings(*encoder.decode(values, bounds))})

    return rows.mapInArrow(work, schema)
