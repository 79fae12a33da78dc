"""Language identification by cross-parsing entropy.

A bounded sample of labelled passages per language becomes a suffix automaton,
which recognises every substring of the sample.  A text is parsed against each
automaton into phrases, each the longest match from where the last one ended
(an unseen byte ends its phrase).  The count of phrases, times the logarithm of
the sample's size and divided by the length, estimates the cross entropy; the
language that needs the fewest wins.

Texts are parsed in passages of ``PASSAGE`` bytes, all of them, many side by
side, so that a step of the parse is one table look-up for thousands of
passages.  Memory in a task is bounded by the tables and one slice of texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import appended, slices

# Bytes parsed in one go; a phrase ends with its passage.
PASSAGE = 256
# The bounded sample: so many texts of each language, and so many bytes from each.
SAMPLE_TEXTS = 128
SAMPLE_BYTES = 192
UNKNOWN = "und"
_SPLITS = 32

_PAD, _UNSEEN = 0, 1
_COUNT_BIT = 30
_STATE = (1 << _COUNT_BIT) - 1
# Passages parsed side by side: their states stay in a core's cache.
_SIDE_BY_SIDE = 8192


@dataclass
class Model:
    """Learned languages, the class of each byte, and a transition table per language."""

    languages: list[str]
    classes: np.ndarray
    n_classes: int
    tables: list[np.ndarray]
    log_sizes: np.ndarray


def _folded(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace").translate(_LETTERS)


# ASCII letters and bytes of longer characters stay; all other bytes count as a blank.
_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def suffix_automaton(codes: np.ndarray) -> list[dict[int, int]]:
    """The transitions of the automaton of all substrings of ``codes``; state 0 is the start."""
    edges: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes.tolist():
        new = len(edges)
        edges.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = new
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(edges)
                edges.append(dict(edges[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return edges


def _table(codes: np.ndarray, n_classes: int) -> np.ndarray:
    """Next state times ``n_classes`` for (state, class), plus a bit where a phrase ends.

    Padding ends a phrase and returns to the start.  A missing edge ends the
    phrase and begins the next one with the same byte.
    """
    edges = suffix_automaton(codes)
    start = np.full(n_classes, 1 << _COUNT_BIT, np.int32)
    for c, to in edges[0].items():
        start[c] = to * n_classes
    table = np.repeat((start | (1 << _COUNT_BIT))[None, :], len(edges), axis=0)
    table[0] = start
    for state, out in enumerate(edges):
        for c, to in out.items():
            table[state, c] = to * n_classes
    table[:, _PAD] = 1 << _COUNT_BIT
    table[0, _PAD] = 0
    return table.ravel()


def _has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def learn(examples: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model:
    """A model from labelled rows.

    At most ``SAMPLE_TEXTS`` texts of each language are used, those with the
    smallest hash of ``key`` and text, and from each the ``SAMPLE_BYTES`` at a
    place that the hash names.  Rows without language or letters do not count.
    """
    order = F.xxhash64(F.col(key).cast("string"), text)
    rows = examples.filter(F.col(lang).isNotNull() & _has_letter(F.col(text))).select(
        F.col(lang).alias("lang"), order.alias("pick"), F.col(text).alias("text")
    )
    # The choice moves hashes only; the texts chosen are fetched by their hash.
    hashes = rows.select("lang", "pick").distinct()
    # Ranked per split first: a language may hold any share of the rows.
    split = Window.partitionBy("lang", F.pmod("pick", F.lit(_SPLITS))).orderBy("pick")
    hashes = hashes.withColumn("n", F.row_number().over(split)).filter(F.col("n") <= SAMPLE_TEXTS)
    ranked = hashes.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("pick")))
    chosen = ranked.filter(F.col("n") <= SAMPLE_TEXTS).select("lang", "pick")
    # The passage starts at a character that the hash names.
    room = F.greatest(F.length("text") - SAMPLE_BYTES + 1, F.lit(1))
    picked = rows.join(F.broadcast(chosen), ["lang", "pick"]).select(
        "lang", "pick", F.substring("text", F.pmod("pick", room).cast("int") + 1, F.lit(SAMPLE_BYTES)).alias("passage")
    )
    passages: dict[str, dict[int, bytes]] = {}
    for row in picked.distinct().collect():
        passages.setdefault(row.lang, {})[row.pick] = _folded(row.passage)
    languages = sorted(passages)
    texts = {k: [v for _, v in sorted(passages[k].items())] for k in languages}
    seen = np.array(sorted(set(b"".join(b"".join(x) for x in texts.values()))), np.int64)
    classes = np.full(256, _UNSEEN, np.uint8)
    classes[seen] = np.arange(2, 2 + len(seen))
    n_classes = 2 + len(seen)
    tables, sizes = [], []
    for k in languages:
        joined = [np.append(classes[np.frombuffer(x, np.uint8)], _PAD) for x in texts[k]]
        codes = np.concatenate(joined)
        tables.append(_table(codes, n_classes))
        sizes.append(np.log2(len(codes) + 1))
    return Model(languages, classes, n_classes, tables, np.array(sizes))


def phrase_counts(model: Model, texts: list[bytes]) -> np.ndarray:
    """Phrases that each text needs in each language, one row per text."""
    rows = np.array([-(-len(x) // PASSAGE) for x in texts], np.int64)
    total = int(rows.sum())
    counts = np.zeros((total, len(model.languages)), np.int32)
    codes = np.full((total, PASSAGE), _PAD, np.uint8)
    flat, at = codes.ravel(), np.cumsum(rows) - rows
    for start, x in zip(at.tolist(), texts):
        flat[start * PASSAGE : start * PASSAGE + len(x)] = model.classes[np.frombuffer(x, np.uint8)]
    for begin in range(0, total, _SIDE_BY_SIDE):
        block = codes[begin : begin + _SIDE_BY_SIDE].T.astype(np.int32, order="C")
        for k, table in enumerate(model.tables):
            state = np.zeros(block.shape[1], np.int32)
            count = np.zeros(block.shape[1], np.int32)
            for step in block:
                state += step
                got = table.take(state)
                count += got >> _COUNT_BIT
                state = got & _STATE
            counts[begin : begin + _SIDE_BY_SIDE, k] = count + (state > 0)
    return _sum_rows(counts, rows)


def _sum_rows(counts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    ends = np.cumsum(rows)
    sums = np.vstack([np.zeros((1, counts.shape[1]), np.int64), np.cumsum(counts, axis=0, dtype=np.int64)])
    return sums[ends] - sums[ends - rows]


def predict(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """The rows of ``docs`` with a language and a score; columns of those names are replaced.

    The score is the share of the runner-up's phrases in those of the best two,
    0.5 for a tie and 1 where one language only is known.  A text that is null
    or has no letter gets ``und`` and 0, as does every text if nothing was learned.
    A tie goes to the language that sorts first.
    """
    columns = [c for c in docs.columns if c not in (lang, score)]
    rows = docs.select(*(F.col(f"`{c}`") for c in columns), _has_letter(F.col(text)).alias("_has_letter"))
    schema = T.StructType(
        [f for f in rows.schema.fields if f.name != "_has_letter"]
        + [T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())]
    )
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.languages, UNKNOWN], object)
        for batch in batches:
            for part in slices(batch, text):
                lettered = part.column("_has_letter").to_numpy(zero_copy_only=False)
                texts = [_folded(x or "") for x in part.column(text).to_pylist()]
                best, sure = np.full(len(texts), len(names) - 1), np.zeros(len(texts))
                if model.languages:
                    costs = phrase_counts(model, texts) * model.log_sizes
                    best = np.where(lettered, costs.argmin(axis=1), best)
                    two = np.sort(costs, axis=1)[:, :2]
                    share = two[:, 1] / np.maximum(two.sum(axis=1), 1e-9) if two.shape[1] > 1 else np.ones(len(texts))
                    sure = np.where(lettered, share, 0.0)
                yield appended(part, ["_has_letter"], **{lang: pa.array(names[best], pa.string()), score: sure})

    return rows.mapInArrow(judge, schema)
