import numpy as np
import pytest

from clustervitals.llm import quality, queries


def test_gradient_equals_differences():
    r = np.random.default_rng(3)
    counts, y = np.array([1, 4, 2]), np.array([1.0, 0.0, 1.0])
    x = r.normal(size=(7, quality.FEATURES))
    model = quality.fit(x[:0], counts[:0], y[:0])
    loss = lambda: -np.mean(y * np.log(p := model.forward(x, counts)["p"]) + (1 - y) * np.log(1 - p))
    for name, g in model.gradient(x, counts, y).items():
        at = tuple(k // 2 for k in g.shape)
        old = model.weights[name]
        change = np.zeros_like(old)
        change[at] = 1e-6
        model.weights[name] = old + change
        up = loss()
        model.weights[name] = old - change
        down = loss()
        model.weights[name] = old
        assert g[at] == pytest.approx((up - down) / 2e-6, abs=1e-6)


def test_attention_finds_the_telling_passage():
    r = np.random.default_rng(4)
    counts = r.integers(1, 8, 400)
    # Ten noisy features; with noise in all of them 300 bags are too few to learn from.
    x = np.zeros((counts.sum(), quality.FEATURES), np.float32)
    x[:, :10] = r.normal(size=(len(x), 10))
    y = r.integers(0, 2, 400).astype(float)
    starts = np.cumsum(counts) - counts
    telling = starts + r.integers(0, counts)
    x[telling, 5] += np.where(y == 1, 6, 0)
    model = quality.fit(x[: starts[300]], counts[:300], y[:300])
    p = model.scores(x[starts[300] :], counts[300:])
    assert ((p > 0.5) == (y[300:] == 1)).mean() > 0.9


def test_features_of_odd_texts():
    texts = [b"", b"a", b"x" * 1025, "é".encode() * 300]
    bounds = np.cumsum([0, *map(len, texts)])
    x, counts = quality.passage_features(np.frombuffer(b"".join(texts), np.uint8), bounds)
    assert counts.tolist() == [1, 1, 3, 2] and np.isfinite(x).all() and not x[0].any()


def test_nulls_ties_repeated_rows_and_clashing_names(spark):
    docs = spark.createDataFrame(
        [(1, "good words here", 9.0), (2, "bad bad bad", 9.0), (2, "bad bad bad", 9.0), (3, None, 9.0), (None, "", 9.0)],
        "doc_id long, text string, score double",
    )
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (7, 1), (1, None), (None, 0)], "doc_id long, quality int")
    model = quality.learn(docs, labels)
    rows = quality.score(docs, model).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    scores = {r.doc_id: r.score for r in rows}
    assert scores[3] == scores[None]
    assert quality.score(docs.limit(0), quality.learn(docs.limit(0), labels)).collect() == []


def test_registered_query_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = dict(queries.table(spark, sf_dir, "labels").select("doc_id", "quality").collect())
    rows = queries.QUERIES["op2_quality"](spark, sf_dir).collect()
    assert len(rows) == queries.table(spark, sf_dir, "documents").count()
    judged = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert len(judged) > 50 and sum(p == q for p, q in judged) / len(judged) > 0.93
