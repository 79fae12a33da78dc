from itertools import combinations

from clustervitals.llm import urls


def plain_rules(rows):
    """{(tokens, verdict): confidence} of the rules that no proper part makes superfluous, by all subsets."""
    sure = {}
    for n in range(1, 1 + max(len(t) for t, _ in rows)):
        for part in {p for t, _ in rows for p in combinations(sorted(t), n)}:
            held = [v for t, v in rows if set(part) <= set(t)]
            for v in set(held):
                if held.count(v) / len(held) >= urls.MIN_CONFIDENCE and held.count(v) >= urls.MIN_SUPPORT * len(rows):
                    sure[part, v] = held.count(v) / len(held)
    return {
        (a, v): c for (a, v), c in sure.items()
        if not any(sure.get((p, v), 0) >= c for n in range(1, len(a)) for p in combinations(a, n))
    }


def mined(spark, rows):
    found = urls.mine_rules(spark.createDataFrame(rows, "t array<string>, verdict string"), "t", "verdict").collect()
    assert len(found) == len({(tuple(r.antecedent), r.verdict) for r in found})
    return {(tuple(r.antecedent), r.verdict): r.confidence for r in found}


def test_surest_rule_of_four_tokens(spark):
    labelled = [("http://x.org/a/b/c/d", "block")] * 20
    labelled += [(f"http://x.org/{'/'.join(p)}", "allow") for p in combinations("abcd", 3)] * 20
    labels = spark.createDataFrame(labelled, "url string, verdict string")
    pages = spark.createDataFrame([(1, "http://y.org/d/c/b/a"), (2, "http://y.org/a/b/c")], "page_id int, url string")
    got = {r.page_id: r for r in urls.judge_urls(pages, [], labels=labels).collect()}
    assert (got[1].verdict, got[1].confidence, got[1].mined_rule) == ("block", 1, "path:a path:b path:c path:d")
    assert got[2].verdict == "allow"


def test_long_rules_equal_brute_force(spark):
    # abcd is as sure as 0.9, its parts of three less so, ab more.
    counts = {"abcd": (18, 2), "abc": (0, 3), "abd": (0, 3), "acd": (0, 3), "bcd": (0, 3), "ab": (100, 0), "a": (0, 40), "b": (0, 40)}
    rows = [(list(t), v) for t, n in counts.items() for v, k in zip(("block", "allow"), n) for _ in range(k)]
    want = plain_rules(rows)
    assert (("a", "b"), "block") in want and (("a", "b", "c", "d"), "block") not in want
    assert mined(spark, rows) == want


def test_rules_of_five_tokens_equal_brute_force(spark):
    rows = [(list("abcde"), "block")] * 10 + [(list(p), "allow") for p in combinations("abcde", 4)] * 6
    want = plain_rules(rows)
    assert (tuple("abcde"), "block") in want
    assert mined(spark, rows) == want
