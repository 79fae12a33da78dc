"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages, of which only the bag has a label.  Each
passage is encoded, a gated attention network gives it a weight among those of
its document, and the weighted sum of the encodings is scored.  Encoder,
attention and score are learned together from document labels.

Fitting uses a bounded sample of labelled rows: at most ``SAMPLE_ROWS``, those
with the smallest hash of their key, of texts of up to ``SAMPLE_BYTES``.
Scoring covers every passage of every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import appended, slices, utf8

PASSAGE = 512
SAMPLE_ROWS = 3000
SAMPLE_BYTES = 1 << 15
HASHED, HIDDEN, ATTENTION = 256, 24, 12
EPOCHS, BATCH, RATE, DECAY = 30, 64, 4e-3, 1e-4

# Bytes by kind: other control, blank, line end, digit, upper case, lower case, mark, part of a longer character.
_KINDS = 8
_KIND = np.zeros(256, np.int64)
_KIND[[9, 32]], _KIND[[10, 13]] = 1, 2
_KIND[33:127] = 6
_KIND[48:58], _KIND[65:91], _KIND[97:123], _KIND[128:] = 3, 4, 5, 7
FEATURES = HASHED + _KINDS + 3
_SLICE = 1 << 20


def passage_features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of texts laid one after another, and how many each text has (at least one).

    Features: hashed byte trigrams (square roots of their shares), shares of
    kinds of bytes, how much the trigrams and the bytes repeat, and the length.
    """
    sizes = np.diff(bounds)
    counts = np.maximum(1, -(-sizes // PASSAGE))
    first = np.cumsum(counts) - counts
    doc = np.repeat(np.arange(len(sizes)), sizes)
    of = first[doc] + (np.arange(len(data)) - bounds[doc]) // PASSAGE
    n = int(counts.sum())
    x = np.zeros((n, FEATURES), np.float32)
    lengths = np.bincount(of, minlength=n)
    whole = np.maximum(lengths, 1)[:, None]
    kinds = np.bincount(of * _KINDS + _KIND[data], minlength=n * _KINDS).reshape(n, _KINDS)
    x[:, HASHED : HASHED + _KINDS] = kinds / whole
    if len(data) > 2:
        same = of[2:] == of[:-2]
        mixed = data[:-2].astype(np.uint32) * np.uint32(2654435761) ^ data[1:-1].astype(np.uint32) * np.uint32(2246822519)
        mixed = (mixed ^ data[2:].astype(np.uint32) * np.uint32(3266489917)) * np.uint32(668265263)
        cell = of[:-2][same] * HASHED + (mixed[same] >> np.uint32(16)) % HASHED
        grams = np.bincount(cell, minlength=n * HASHED).reshape(n, HASHED) / whole
        x[:, :HASHED] = np.sqrt(grams)
        x[:, -3] = (grams**2).sum(axis=1)
        again = np.append(data[1:] == data[:-1], False) & np.append(of[1:] == of[:-1], False)
        x[:, -2] = np.bincount(of[again], minlength=n) / whole[:, 0]
    x[:, -1] = np.log1p(lengths) / 8
    return x, counts


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        w, starts = self.weights, np.cumsum(counts) - counts
        bag = np.repeat(np.arange(len(counts)), counts)
        h = np.tanh(x @ w["encode"] + w["encode_bias"])
        t, s = np.tanh(h @ w["attend"]), _sigmoid(h @ w["gate"])
        e = (t * s) @ w["weigh"]
        grown = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        a = grown / np.add.reduceat(grown, starts)[bag]
        z = np.add.reduceat(a[:, None] * h, starts)
        return {"h": h, "t": t, "s": s, "a": a, "z": z, "p": _sigmoid(z @ w["score"] + w["score_bias"][0]), "bag": bag, "starts": starts}

    def scores(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if not len(counts):
            return np.zeros(0)
        return self.forward((x - self.mean) / self.scale, counts)["p"].astype(np.float64)

    def gradient(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w, f = self.weights, self.forward(x, counts)
        g = (f["p"] - y) / len(y)
        back = g[:, None] * w["score"]
        inner = (f["h"] * back[f["bag"]]).sum(axis=1)
        e = f["a"] * (inner - np.add.reduceat(f["a"] * inner, f["starts"])[f["bag"]])
        gated = e[:, None] * w["weigh"]
        t, s = gated * f["s"] * (1 - f["t"] ** 2), gated * f["t"] * f["s"] * (1 - f["s"])
        h = (f["a"][:, None] * back[f["bag"]] + t @ w["attend"].T + s @ w["gate"].T) * (1 - f["h"] ** 2)
        return {
            "score": f["z"].T @ g, "score_bias": g.sum(keepdims=True), "weigh": (f["t"] * f["s"]).T @ e,
            "attend": f["h"].T @ t, "gate": f["h"].T @ s, "encode": x.T @ h, "encode_bias": h.sum(axis=0),
        }


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(x: np.ndarray, counts: np.ndarray, y: np.ndarray, seed: int = 1) -> Model:
    """Learn from bags of passages with labels 0 and 1 by Adam steps on the log loss."""
    r = np.random.default_rng(seed)
    shapes = {
        "encode": (FEATURES, HIDDEN), "encode_bias": (HIDDEN,), "attend": (HIDDEN, ATTENTION), "gate": (HIDDEN, ATTENTION),
        "weigh": (ATTENTION,), "score": (HIDDEN,), "score_bias": (1,),
    }
    start = {k: r.normal(0, 1 / np.sqrt(v[0]), v) * (not k.endswith("bias")) for k, v in shapes.items()}
    if not len(y):
        return Model(np.zeros(FEATURES, np.float32), np.ones(FEATURES, np.float32), start)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    model, x = Model(mean, scale, start), (x - mean) / scale
    share = np.clip(y.mean(), 0.01, 0.99)
    model.weights["score_bias"] = np.array([np.log(share / (1 - share))])
    starts = np.cumsum(counts) - counts
    first, second = ({k: np.zeros(v) for k, v in shapes.items()} for _ in range(2))
    step = 0
    for epoch in range(EPOCHS):
        order = r.permutation(len(y))
        for part in np.array_split(order, max(1, len(order) // BATCH)):
            rows = np.concatenate([np.arange(starts[b], starts[b] + counts[b]) for b in part])
            step += 1
            rate = RATE * (1 - epoch / EPOCHS) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, g in model.gradient(x[rows], counts[part], y[part]).items():
                g = g + DECAY * model.weights[k] * (not k.endswith("bias"))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g**2
                model.weights[k] = model.weights[k] - rate * first[k] / (np.sqrt(second[k]) + 1e-8)
    model.weights = {k: v.astype(np.float32) for k, v in model.weights.items()}
    return model


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Fit on a bounded sample of the rows of ``docs`` that have a label 0 or 1 in ``labels``.

    A document with several labels counts once for each; a null text is empty.
    Without labels the model scores by chance.
    """
    marked = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(label).alias("y"))
    known = docs.filter(F.coalesce(F.octet_length(text), F.lit(0)) <= SAMPLE_BYTES).select(F.col(key).alias("key"))
    picked = known.join(marked, "key").orderBy(F.xxhash64("key"), "key", "y").limit(SAMPLE_ROWS).distinct()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(picked), "key")
    rows = rows.filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_BYTES)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                x, counts = passage_features(*utf8(part.column("text")))
                ends = np.cumsum(counts)
                yield pa.RecordBatch.from_pydict({
                    "key": part.column("key").cast(pa.string()), "y": part.column("y").cast(pa.int32()),
                    "x": pa.array([x[a:b].tobytes() for a, b in zip(ends - counts, ends)], pa.binary()),
                })

    found = sorted(rows.mapInArrow(encode, "key string, y int, x binary").collect(), key=lambda r: (r.key, r.y, bytes(r.x)))
    bags = [np.frombuffer(bytes(r.x), np.float32).reshape(-1, FEATURES) for r in found]
    x = np.concatenate([*bags, np.zeros((0, FEATURES), np.float32)])
    return fit(x, np.array([len(b) for b in bags], np.int64), np.array([r.y for r in found], np.float64))


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """The rows of ``docs`` with a score from 0 to 1, higher for likelier good ones; a column ``name`` is replaced."""
    rows = docs.select(*(c for c in docs.columns if c != name))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, _SLICE):
                yield appended(part, [], **{name: shared.value.scores(*passage_features(*utf8(part.column(text))))})

    return rows.mapInArrow(judge, T.StructType([*rows.schema.fields, T.StructField(name, T.DoubleType())]))
