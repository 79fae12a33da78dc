from clustervitals.llm import quotes

LINES = "Hello,\nthe first half of it\nand the second half\nwith an end."
PARAGRAPHS = "One came\nfirst.\n\nTwo came next.\n\nThree came\nlast."

ROWS = [
    (1, 0, "user", "Hello,"),
    (1, 1, "assistant", LINES),
    (1, 2, "user", PARAGRAPHS),
    (1, 3, "assistant", "unrelated"),
    # Some lines of a paragraph, with replies between them.
    (1, 4, "user", "> Hello,\n> the first half of it\nYes.\n> and the SECOND half\n> with an end.\nNo."),
    # Two of three paragraphs, from the front and from the back.
    (1, 5, "user", "> One came\n> first.\n>\n> Two came next.\nIndeed."),
    (1, 6, "user", "> Two came next.\n>\n> Three came\n> last.\nIndeed."),
    # One line of several is known; none is known.
    (1, 7, "user", "> never said\n> and the second half\nWho?"),
    (1, 8, "user", "> never said\n> nor this\nWho?"),
    # The own conversation comes before the others.
    (2, 0, "user", "Two came next."),
    (2, 1, "user", "> Two came next.\n>\n> Three came\n> last.\nIndeed."),
    (2, 2, "user", "> the first half of it\n> and the second half\nIndeed."),
    # A holder that comes later is none.
    (2, 3, "user", "> still to be said\n> and more\nWhat?"),
    (2, 4, "user", "Still to be said."),
]


def test_parts_of_paragraphs_and_messages(spark):
    rows = spark.createDataFrame([(*r, "x") for r in ROWS], "conv_id long, turn long, role string, text string, place string")
    got = {(r.conv_id, r.turn): r for r in quotes.link_quotes(rows).collect()}
    assert len(got) == len(ROWS)
    parent = {k: (r.parent_conversation, r.parent_place, r.by_quote, r.n_quotes, r.n_linked) for k, r in got.items()}
    assert parent[1, 4] == (1, 1, True, 2, 2)
    assert parent[1, 5] == (1, 2, True, 1, 1) and parent[1, 6] == (1, 2, True, 1, 1)
    assert parent[1, 7] == (1, 1, True, 1, 1) and parent[1, 8] == (1, 7, False, 1, 0)
    assert parent[2, 1] == (2, 0, True, 1, 1) and parent[2, 2] == (1, 1, True, 1, 1)
    assert parent[2, 3] == (2, 2, False, 1, 0)
    assert got[1, 4].text == "Yes.\nNo."
