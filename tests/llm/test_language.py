import random

import numpy as np
import pytest

from clustervitals.llm import language, queries


def plain_phrases(text, samples):
    """Phrases by the definition: the longest match with a sample from where the last phrase ended."""
    count = 0
    for start in range(0, len(text), language.PASSAGE):
        x = text[start : start + language.PASSAGE]
        at = 0
        while at < len(x):
            end = at
            while end < len(x) and any(x[at : end + 1] in s for s in samples):
                end += 1
            # A byte that no sample of the language holds ends its phrase.
            at = end + 1 if end < len(x) and not any(x[end : end + 1] in s for s in samples) else end
            count += 1
    return count


def model_of(samples):
    seen = np.array(sorted(set(b"".join(b"".join(x) for x in samples.values()))), np.int64)
    classes = np.full(256, 1, np.uint8)
    classes[seen] = np.arange(2, 2 + len(seen))
    tables = [
        language._table(np.concatenate([np.append(classes[np.frombuffer(x, np.uint8)], 0) for x in samples[k]]), 2 + len(seen))
        for k in sorted(samples)
    ]
    return language.Model(sorted(samples), classes, 2 + len(seen), tables, np.ones(len(samples)))


@pytest.mark.parametrize("seed", [1, 2])
def test_phrases_equal_the_definition(seed):
    r = random.Random(seed)
    samples = {k: [bytes(r.choices(a, k=60)) for _ in range(3)] for k, a in (("p", b"abc "), ("q", b"bcd "))}
    texts = [bytes(r.choices(b"abcd z", k=n)) for n in (0, 1, 5, 255, 256, 257, 600)]
    got = language.phrase_counts(model_of(samples), texts)
    assert got.tolist() == [[plain_phrases(x, samples[k]) for k in sorted(samples)] for x in texts]


def test_odd_texts_and_clashing_names(spark):
    learned = [(k, "la casa del gato que come y duerme " * 3, "es") for k in range(5)]
    learned += [(9 + k, "the house of the cat that eats and sleeps " * 3, "en") for k in range(5)] + [(20, "zzz", None), (21, None, "xx")]
    examples = spark.createDataFrame(learned, "doc_id long, text string, lang string")
    model = language.learn(examples)
    assert model.languages == ["en", "es"]
    rows = [(1, "The cat sleeps", "a"), (2, "el gato duerme", "b"), (2, "el gato duerme", "b"), (3, None, "c"), (4, "", "d"), (5, "12 !?", "e"), (None, "x" * 100_000, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = [(r.doc_id, r.lang_pred, r.score) for r in language.predict(docs, model).collect()]
    assert [g[1] for g in got[:6]] == ["en", "es", "es", "und", "und", "und"] and got[6][1] in ("en", "es")
    assert all((s == 0) == (p == "und") and 0 <= s <= 1 for _, p, s in got)
    assert language.predict(docs.limit(0), model).collect() == []
    nothing = language.learn(examples.limit(0))
    assert {r.lang_pred for r in language.predict(docs, nothing).collect()} == {"und"}


def test_registered_query_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.01"
    lang = dict(queries.table(spark, sf_dir, "documents").select("doc_id", "lang").collect())
    rows = queries.QUERIES["op9_language"](spark, sf_dir).collect()
    assert len(rows) == len(lang)
    judged = [r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]
    assert len(judged) > 200 and sum(judged) / len(judged) > 0.98
