"""What the pipeline leaves on disk while it runs."""

import collections
import random
import re
import time

import corpus_pipeline
from pyspark.sql import functions as F

from clustervitals.llm import jaccard
from clustervitals.sources.workspace import keep

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


def shuffled(spark, known=()):
    """Bytes on disk of each shuffle but the known ones."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    sizes = collections.Counter()
    for f in (files.apply(i) for i in range(files.size())):
        if m := re.match(r"shuffle_(\d+)_", f.getName()):
            sizes[m[1]] += f.length()
    return {k: n for k, n in sizes.items() if n and k not in known}


def left_over(spark, known, most=0):
    """Bytes of further shuffles, once at most ``most`` or not soon to be less; files go beside what runs."""
    for _ in range(50):
        n = sum(shuffled(spark, known).values())
        if n <= most:
            break
        time.sleep(0.1)
    return n


def test_kept_rows_leave_no_shuffle(spark):
    known = shuffled(spark)
    rows = spark.range(1000).repartition(5, "id").withColumn("k", F.col("id") % 7)
    joined = rows.groupBy("k").count().join(rows.hint("merge"), "k")
    found = keep(joined)
    assert left_over(spark, known) == 0
    assert found.count() == joined.count() == 1000 and sorted(found.columns) == ["count", "id", "k"]
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) in (None, "false")


def test_near_duplicates_leave_no_shuffle_of_earlier_steps(spark, monkeypatch):
    r, known = random.Random(3), shuffled(spark)
    docs = [[f"w{r.randrange(4000)}" for _ in range(400)] for _ in range(60)]
    docs += [[*d[:200], "changed", *d[201:]] for d in docs[:30]]
    rows = spark.createDataFrame([(k, " ".join(d), "en", "s", 0) for k, d in enumerate(docs)], SCHEMA)
    held = []  # what is referred to is not collected as garbage, which would free files by chance
    for module in (jaccard, corpus_pipeline):
        monkeypatch.setattr(module, "keep", lambda df: held.append((df, keep(df))) or held[-1][1])
    left = corpus_pipeline.drop_near_duplicates(spark, rows, None)
    # Of counts alone, not of cells, sets or texts.
    size = sum(len(" ".join(d)) for d in docs)
    assert len(held) > 5 and left_over(spark, known, 0.05 * size) < 0.05 * size
    assert {x.doc_id for x in left.collect()} == set(range(60))


def test_few_rows_move_to_the_join_with_keys(spark):
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 500 > 0, F.col("id") - 10_000).alias("k"), F.col("id").cast("string").alias("_text")
    )
    for keys in ([-9_999, -1, 1, 9_999, 123_456], []):
        wanted = spark.createDataFrame([(k,) for k in keys], "k long")
        likely, rest = jaccard.parted(rows, wanted, "k")
        assert likely.columns == rest.columns == rows.columns
        assert likely.count() + rest.count() == 20_000 and likely.count() < 200
        assert rest.join(wanted, "k").isEmpty()
        assert likely.join(wanted, "k").count() == max(0, len(keys) - 1)


def test_repeated_strings_keep_no_anchors_on_disk(spark):
    r, known = random.Random(4), shuffled(spark)
    letters = [chr(c) for c in range(33, 127)]
    docs = ["".join(r.choices(letters, k=6000)) for _ in range(60)]
    docs[1:11] = [docs[k][:5000] + docs[0][:1000] for k in range(1, 11)]
    rows = spark.createDataFrame([(k, d, "en", "s", 0) for k, d in enumerate(docs)], SCHEMA)
    cut = corpus_pipeline.cut_repeats(spark, rows, None)
    texts = {x.doc_id: x.text for x in cut.collect()}
    assert texts == {k: d[:5000] if 1 <= k < 11 else d for k, d in enumerate(docs)}
    # The texts are there, moved to meet their marks, but no longer the anchors of all windows.
    assert left_over(spark, known, 1.3 * 360_000) < 1.3 * 360_000
