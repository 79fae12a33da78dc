import brute
import corpus_pipeline
import sentencepiece

from clustervitals.llm import language, queries

SF_DIR = "/root/testdata/sf0.001"


def stage_results(spark, folder):
    docs, out = queries.table(spark, SF_DIR, "documents"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        columns = docs.columns
        stage(spark, docs, SF_DIR).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append(docs.collect())
        assert docs.columns == columns or k == len(corpus_pipeline.STAGES) - 1
    return out


def test_stages_equal_brute_force(spark, tmp_path):
    before = queries.table(spark, SF_DIR, "documents").collect()
    known, near, cut, clean, encoded = stage_results(spark, tmp_path)

    predicted = queries.QUERIES["op9_language"](spark, SF_DIR).collect()
    lang = {r.doc_id: r.lang_pred for r in predicted if r.lang_pred != language.UNKNOWN}
    assert {(r.doc_id, r.text, r.lang) for r in known} == {(r.doc_id, r.text, lang[r.doc_id]) for r in before if r.doc_id in lang}

    groups = brute.jaccard_components([(r.doc_id, r.text) for r in known], num=80, den=100, size=5)
    assert {r.doc_id for r in near} == {d for d, (_, c) in groups.items() if c == d}

    left = brute.repeats([(r.doc_id, r.text) for r in near])
    assert {r.doc_id: r.text for r in cut} == {d: kept.decode("utf-8", "ignore") for d, (_, _, kept) in left.items()}
    assert all(r.n_chars == len(r.text) for r in cut)

    items = queries.table(spark, SF_DIR, "benchmark").collect()
    hits = brute.decontamination([(r.doc_id, r.text) for r in cut], [(r.item_id, r.text) for r in items])
    for r, earlier in zip(sorted(clean), sorted(cut)):
        assert r.doc_id == earlier.doc_id and (r.text == earlier.text) == (hits[r.doc_id][1] == 0)
        words = len(brute.WORD.findall(brute.lower_ascii(r.text)))
        assert words == hits[r.doc_id][0] - hits[r.doc_id][1]

    library = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path("piece_bpe_32k.model"))
    for r, earlier in zip(sorted(encoded), sorted(clean)):
        ids = library.encode(earlier.text or "")
        assert (r.doc_id, r.n_tokens, r.ids_sha256) == (earlier.doc_id, len(ids), brute.sha(",".join(map(str, ids))))


def test_documents_without_text_or_key(spark, tmp_path):
    rows = [(1, None, "en", "s", 0), (None, "the words of a text here", "en", "s", 24), (2, "", None, None, None), (3, "the words", "en", "s", 9)]
    docs = spark.createDataFrame(rows, queries.table(spark, SF_DIR, "documents").schema)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF_DIR).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    # Documents without letters are in no language.
    assert sorted(str(r.doc_id) for r in docs.collect()) == ["3", "None"]


def test_empty_documents(spark, tmp_path):
    docs = queries.table(spark, SF_DIR, "documents").limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF_DIR).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    assert docs.count() == 0
