import random

import brute
import pytest

from clustervitals.llm import decontaminate, queries

SCHEMA = "doc_id long, text string, n_words string"


def documents_and_items(seed):
    r = random.Random(seed)
    words = ["the", "Of", "an", "x1", "été", "quick", "brown"]

    def text(n):
        return "".join(r.choice(words) + r.choice([" ", ", ", "\n", " - "]) for _ in range(n))

    items = [(k, text(r.choice([0, 1, 3, 9, 10, 11, 25]))) for k in range(12)] + [(3, text(14)), (None, text(4)), (99, None)]
    docs = [(k, text(r.choice([0, 2, 9, 30, 60]))) for k in range(60)]
    docs += [(100 + k, "zzz " + items[k % 12][1] + " zzz") for k in range(30)]
    return docs + [(200, None), (201, ""), (202, docs[70][1]), (202, docs[70][1])], items


def run(spark, docs, items, **options):
    found = decontaminate.find_phrases(
        spark.createDataFrame([(*d, "x") for d in docs], SCHEMA),
        spark.createDataFrame(items, "item_id long, text string"),
        **options,
    )
    return found.collect()


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("block_bytes", [1 << 20, 150])
def test_equals_brute_force(spark, seed, block_bytes):
    docs, items = documents_and_items(seed)
    want = brute.decontamination(docs, items)
    got = run(spark, docs, items, block_bytes=block_bytes)
    assert len(got) == len(docs)
    for row in got:
        assert (row.n_words, row.n_hit, row["items"]) == want[row.doc_id]


def test_spans_cover_hit_words_and_can_be_cut(spark):
    items = [(1, "a b c d e f g h i j k")]
    docs = [(1, "é A, b c d e f g h i J k! end"), (2, "clean words stay"), (3, None)]
    rows = {r.doc_id: r for r in run(spark, docs, items)}
    assert [(s.start, s.end) for s in rows[1].spans] == [(3, 25)]
    cut = {r.doc_id: r for r in run(spark, docs, items, cut=True)}
    assert cut[1].text == "é ! end" and cut[2].text == docs[1][1] and cut[3].text is None


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b")]) == []
    assert run(spark, [(1, "a b")], [])[0].n_hit == 0


def test_long_repeated_runs(spark):
    text = " ".join(["a b c d e f g h i j"] * 3000)
    row = run(spark, [(1, text), (2, text)], [(7, "a b c d e f g h i j")])[0]
    assert row.n_words == row.n_hit == 30000 and row["items"] == ["7"]


def test_registered_query(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = queries.table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    items = queries.table(spark, sf_dir, "benchmark").select("item_id", "text").collect()
    want = brute.decontamination(docs, items)
    got = queries.QUERIES["op6_decontamination"](spark, sf_dir).collect()
    assert len(got) == len(docs) and any(r.contaminated for r in got)
    for r in got:
        n_words, n_hit, found = want[r.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n_words, n_hit, len(found), n_hit > 0)
        assert r.items_sha256 == brute.sha(",".join(found))
