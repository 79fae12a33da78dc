import random

import brute

from clustervitals.llm import queries, quotes


def compare(found, rows):
    want = brute.quotes(rows)
    got = {(r.conv_id, r.place): (r.n_quotes, r.n_linked, r.parent_conversation, r.parent_place, r.by_quote) for r in found}
    assert got == {k: v[1:] for k, v in want.items()}
    return want


def test_links_equal_those_of_going_through_all_messages(spark):
    r = random.Random(21)
    words = ["one", "Two", "three!", "four", "five"]
    rows = []
    for conv in range(30):
        said = []
        for turn in range(r.randint(1, 6)):
            lines = [" ".join(r.choice(words) for _ in range(r.randint(1, 4))) for _ in range(r.randint(1, 4))]
            if r.random() < 0.6 and rows:
                other = r.choice([x[3] for x in rows] + said * 3)
                picked = [x for x in other.split("\n") if r.random() < 0.7] or ["never said at all"]
                lines = [("> " if r.random() < 0.8 else ">") + x for x in picked] + lines
            if r.random() < 0.2:
                lines.insert(1, "")
            said.append("\n".join(lines))
            rows.append((conv, turn, "user", said[-1]))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = compare(quotes.link_quotes(df).collect(), rows)
    assert sum(v[5] for v in want.values()) > 20


def test_query_links_its_replies(spark):
    sf_dir = "/root/testdata/sf0.001"
    given = queries.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = [tuple(r) for r in queries.with_replies(given).collect()]
    found = queries.QUERIES["op5_quotation_links"](spark, sf_dir).collect()
    compare(found, rows)
    replies = [r for r in found if r.turn == 1_000_000]
    assert len(found) == len(rows) and replies and all(r.by_quote for r in replies)
