import pytest

from clustervitals.llm import queries, quotes

ROWS = [
    (1, 0, "user", "Where is the key?\n\nI looked\neverywhere."),
    (1, 1, "assistant", "> where is the KEY\nUnder the mat."),
    (1, 2, "user", "Thanks!"),
    (1, 3, "user", "> Where is the key?\n>\n> I looked\n> everywhere.\nFound it."),
    (1, 4, "assistant", ">> Where is the key?\n> Under the mat.\nGood."),
    (2, 0, "user", "Unrelated"),
    (2, 1, "user", "> Under the mat.\nIs this from elsewhere?"),
    (2, 2, "user", "> never said\nWhat?"),
    (3, 0, "user", None),
    (3, 1, "user", ""),
    (None, 0, "user", "alone"),
]


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, place string")
    return quotes.link_quotes(df).collect()


def test_links_order_and_text(spark):
    got = {(r.conv_id, r.turn): r for r in run(spark, ROWS)}
    parent = {k: (r.parent_conversation, r.parent_place, r.by_quote) for k, r in got.items()}
    assert parent[1, 1] == (1, 0, True) and parent[1, 2] == (1, 1, False) and parent[1, 3] == (1, 0, True)
    # The outer quote decides: its level is the smaller one.
    assert parent[1, 4] == (1, 1, True) and parent[2, 1] == (1, 1, True) and parent[2, 2] == (2, 1, False)
    assert parent[2, 0] == (None, None, False) and parent[None, 0] == (None, None, False)
    assert (got[1, 4].n_quotes, got[1, 4].n_linked) == (2, 2) and (got[2, 2].n_quotes, got[2, 2].n_linked) == (1, 0)
    assert got[1, 3].text == "Found it." and got[2, 2].text == "What?" and got[3, 0].text == ""
    depth = {k: (r.thread, r.depth) for k, r in got.items()}
    assert depth[1, 0] == (1, 0) and depth[1, 1] == (1, 1) and depth[1, 2] == (1, 2) and depth[1, 3] == (1, 1)
    assert depth[1, 4] == (1, 2) and depth[2, 1] == (1, 2) and depth[2, 2] == (1, 3) and depth[2, 0] == (2, 0)
    thread = sorted((r.reply_order, r.depth) for r in got.values() if r.thread == 1)
    assert [o for o, _ in thread] == list(range(7)) and [d for _, d in thread] == sorted(d for _, d in thread)


def test_long_chain_of_quotes(spark):
    rows = [(k, 0, "user", f"message number {k}") for k in range(1)]
    rows += [(k, 0, "user", f"start {k}") for k in range(1, 40)]
    rows += [(k, 1, "user", f"> {'message number 0' if k == 1 else f'answer {k - 1}'}\nanswer {k}") for k in range(1, 40)]
    got = {(r.conv_id, r.turn): r for r in run(spark, rows)}
    assert all((got[k, 1].thread, got[k, 1].depth) == (0, k) for k in range(1, 40))


def test_repeated_rows_ties_and_empty_table(spark):
    got = run(spark, [(1, 0, "user", "a")] * 3 + [(1, None, "user", "b")])
    assert sorted(r.place for r in got) == [0, 1, 2, 3]
    assert run(spark, []) == []


@pytest.mark.parametrize(
    "text,want",
    [
        ("a\n> b\n>c\n>> d\ne", [(0, "a"), (1, "b\nc"), (2, "d"), (0, "e")]),
        (" > > x", [(2, "x")]),
        ("", [(0, "")]),
        (None, [(0, "")]),
        ("a > b\r\n>c", [(0, "a > b"), (1, "c")]),
    ],
)
def test_passages(spark, text, want):
    row = quotes.with_passages(spark.createDataFrame([(text,)], "t string"), "t").first()
    assert [tuple(x) for x in row.passages] == want


def test_very_long_message(spark):
    text = "\n".join(f"{'> ' * (k % 3)}line {k}" for k in range(20000))
    assert {r.n_quotes for r in run(spark, [(1, 0, "user", text)])} == {13333}


def test_registered_query_keeps_all_messages(spark):
    sf_dir = "/root/testdata/sf0.001"
    messages = queries.table(spark, sf_dir, "conversations").collect()
    got = queries.QUERIES["op5_quotation_links"](spark, sf_dir).collect()
    assert sorted((r.conv_id, r.turn) for r in got) == sorted((r.conv_id, r.turn) for r in messages)
