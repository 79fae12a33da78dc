"""URLs with many tokens that come together, few labelled URLs, long URLs and clashing columns."""

import itertools

from clustervitals.llm import urls


def judged(spark, pages, labels, **options):
    pages = spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(pages)], "page_id int, url string, tokens string, verdict string")
    labels = spark.createDataFrame(labels, "url string, verdict string")
    return {r.page_id: r for r in urls.judge_urls(pages, [], labels=labels, **options).collect()}


def brute(labels, page, min_rows=urls.MIN_ROWS):
    """The surest verdict of all combinations of tokens of the page that enough labelled URLs hold."""
    found = []
    known = [(frozenset(u), v) for u, v in labels]
    for n in range(1, len(page) + 1):
        for part in itertools.combinations(sorted(page), n):
            held = [v for t, v in known if t >= set(part)]
            for verdict in set(held):
                hits = held.count(verdict)
                if hits >= max(min_rows, urls.MIN_SUPPORT * len(known)) and hits / len(held) >= urls.MIN_CONFIDENCE:
                    found.append((hits / len(held), verdict))
    return max(found)[0] if found else None, {v for c, v in found if c == max(found)[0]}


def test_forty_shared_keys(spark):
    keys = "&".join(f"k{k}=1" for k in range(40))
    labels = [(f"http://h{k % 5}.org/{k % 7}?{keys}", "block") for k in range(60)] + [(f"http://h{k % 5}.org/a{k % 7}", "allow") for k in range(60)]
    got = judged(spark, [f"http://z.org/q?{keys}", "http://z.org/q?k7=2", "http://z.org/q", "gopher://z"], labels)
    assert [got[k].verdict for k in range(4)] == ["block", "block", "allow", "allow"]
    # The numbers in the paths come with the keys as well.
    assert got[0].confidence == 1 and got[0].mined_rule.count("|") == 40 and got[3].mined_rule is None


def test_one_url_of_many_keys_among_a_hundred(spark):
    keys = "&".join(f"only{k}=1" for k in range(25))
    labels = [(f"http://h{k % 3}.org/p{k % 4}/x", "allow") for k in range(100)] + [(f"http://h1.org/p1?{keys}", "block")]
    got = judged(spark, [f"http://h9.org/q?{keys}", "http://h1.org/p1/x"], labels)
    # One labelled URL is no ground for a rule.
    assert got[0].verdict == "allow" and "only" not in (got[0].mined_rule or "") and got[1].verdict == "allow"


def test_verdicts_equal_all_combinations(spark):
    words = ["a", "b", "c", "d", "e"]
    labels, tokens = [], []
    for k in range(90):
        own = [w for n, w in enumerate(words) if (k >> n) % 3 != 0]
        verdict = "block" if "a" in own and "c" in own or k % 11 == 0 else "allow"
        labels.append(("http:///" + "/".join(own), verdict))
        tokens.append(([f"path:{w}" for w in own] + ["scheme:http"], verdict))
    pages = ["http:///" + "/".join(p) for n in range(6) for p in itertools.combinations(words, n)]
    got = judged(spark, pages, labels)
    for k, page in enumerate(pages):
        parts = {f"path:{w}" for w in page.removeprefix("http:///").split("/") if w} | {"scheme:http"}
        confidence, verdicts = brute(tokens, parts)
        assert got[k].confidence == confidence or abs(got[k].confidence - confidence) < 1e-12, page
        assert got[k].verdict in (verdicts or {"allow"})


def test_a_very_long_url(spark):
    long = "http://h.org/" + "/".join(f"w{k}" for k in range(3000)) + "?" + "&".join(f"k{k}" for k in range(3000)) + "x" * 100_000
    got = judged(spark, [long, "http://h.org/fine"], [(long, "block")] * 4 + [("http://h.org/fine", "allow")] * 4)
    assert (got[0].verdict, got[1].verdict) == ("block", "allow")
