from framekiln.llm import quotations

FIRST = "Shall we meet on Tuesday?\nThe room is free all morning."
SECOND = "On Monday Ann wrote:\n> Shall we meet on Tuesday?\nTuesday is fine for me."
THIRD = ">> shall  we MEET on tuesday?\n> Tuesday is fine for me.\n\nGreat, see you then."
OTHER = "> The room is free all morning.\nWhich room do you mean?"
FAR = "> Tuesday is fine for me.\nquoted in another conversation"

ROWS = [
    (1, 0, "user", FIRST),
    (1, 1, "assistant", SECOND),
    (1, 2, "user", THIRD),
    (1, 3, "user", OTHER),
    (1, 4, "assistant", "no quotation here"),
    (2, 0, "user", FAR),
    (2, 5, "user", "> nobody ever said this\nhm"),
    (2, 7, "user", None),
    (None, 1, "user", "lost"),
    (3, None, "user", "> lost\ntoo"),
    (4, 0, "user", ""),
    (4, 0, "user", ""),
]


def test_conversations(spark):
    table = spark.createDataFrame([(*r, "own", 1) for r in ROWS], "conv_id long, turn long, role string, text string, place string, level int")
    out = {}
    for r in quotations.reply_ordered(table).collect():
        out.setdefault((r.conv_id, r.turn), []).append((r.position, r.reply_turn, r.branch, r.n_quotes, r.n_linked, r.text))
    assert out[1, 0] == [(0, None, 0, 0, 0, FIRST)]
    assert out[1, 1] == [(1, 0, 1, 1, 1, "Tuesday is fine for me.")]
    assert out[1, 2] == [(4, 1, 2, 2, 2, "\nGreat, see you then.")]
    assert out[1, 3] == [(2, 0, 3, 1, 1, "Which room do you mean?")]
    assert out[1, 4] == [(3, 3, 3, 0, 0, "no quotation here")]
    assert out[2, 0] == [(0, None, 0, 1, 1, "quoted in another conversation")]
    assert out[2, 5] == [(1, 0, 0, 1, 0, "hm")]
    assert out[2, 7] == [(2, 5, 0, 0, 0, "")]
    assert out[None, 1] == [(None, None, None, 0, 0, "lost")]
    assert out[3, None] == [(None, None, None, 0, 0, "too")]
    assert out[4, 0] == [(0, None, 0, 0, 0, "")] * 2


def test_links_to_other_conversations(spark):
    table = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    rows = quotations.links(quotations.parsed(table)).collect()
    found = {(r.conv_id, r.turn, r.level): (r.source_conv, r.source_turn) for r in rows}
    assert found == {
        (1, 1, 1): (1, 0),
        (1, 2, 2): (1, 0),
        (1, 2, 1): (1, 1),
        (1, 3, 1): (1, 0),
        (2, 0, 1): (1, 1),
        (2, 5, 1): (None, None),
    }


def test_empty(spark):
    assert quotations.reply_ordered(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
