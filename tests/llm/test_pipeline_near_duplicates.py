import brute
import corpus_pipeline

from clustervitals.llm import queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


def kept(docs, num=80, den=100, size=5):
    """Keys left by comparing all pairs that share a shingle."""
    sets = {d: brute.shingles(text, size) for d, text in docs}
    group, where = {d: {d} for d in sets}, {}
    for d, s in sets.items():
        for g in s:
            where.setdefault(g, []).append(d)
    for a, b in {(a, b) for ds in where.values() for a in ds for b in ds if a < b}:
        if den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]) and group[a] is not group[b]:
            group[a] |= group[b]
            for d in group[b]:
                group[d] = group[a]
    return {d for d, g in group.items() if d == min(g)}


def stage(spark, docs):
    return {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, None).collect()}


def test_links_by_five_words_and_four_fifths(spark):
    words = [f"w{k}" for k in range(100)]

    def changed(*places):
        return " ".join(f"x{k}" if k in places else w for k, w in enumerate(words))

    # 86 of 106 five-word shingles are shared after two changes apart, 81 of 111 after three.
    for places, left in (((30, 60), {1}), ((20, 50, 80), {1, 2})):
        rows = [(1, changed(), "en", "s", 0), (2, changed(*places), "en", "s", 0)]
        assert kept([r[:2] for r in rows]) == left
        assert stage(spark, spark.createDataFrame(rows, SCHEMA)) == left


def test_given_documents_equal_brute_force(spark):
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents")
    assert stage(spark, docs) == kept([(r.doc_id, r.text) for r in docs.collect()])
