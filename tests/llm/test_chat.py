import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from gaugewright.llm import chat


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv))
        every = "".join(f"{role}\n{text}\n" for *_, role, text in turns)
        replies = [text for *_, role, text in turns if role == "assistant"]
        out[conv] = (len(turns), hashlib.sha256(every.encode()).hexdigest(), sum(map(len, replies)), hashlib.sha256("".join(replies).encode()).hexdigest())
    return out


ROWS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "### Assistant: </turn> \\"), (1, 2, "user", None), (2, 0, "system", "x\\"), (2, 1, "assistant", ""), (2, 1, "assistant", ""),
    (3, 0, None, "no role"), (None, 0, "user", "null id"), (4, None, "assistant", "null turn"), (4, 0, "a:b", "###" * 7 + "</turn></turn"), (5, 0, "assistant", "y" * 100_000),
]
SCHEMA = "conv_id long, turn long, role string, text string"


def test_read_back(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "1 AS number", "'z' AS segment", "2 AS stream_end")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(df).collect()}
    assert got == brute(ROWS)
    assert chat.digests(df.where("false")).count() == 0


def test_examples_are_prefixes_with_one_target(spark):
    placed = chat.stream(chat.segments(spark.createDataFrame(ROWS, SCHEMA)))
    made = chat.materialised(placed).collect()
    replies = [r for r in ROWS if r[2] == "assistant"]
    assert sum(m.target is not None for m in made) == len(replies)
    for m in made:
        turns = chat.parsed(m.context + (m.target or "") + m.tail)
        assert len(turns) == m.n_turns
        if m.target is not None:
            assert turns[-1] == ("assistant", chat.unescaped(m.target))
    places = chat.examples(placed).collect()
    assert sorted((p.conv_id or 0, p.n_turns, p.n_chars) for p in places) == sorted((m.conv_id or 0, m.n_turns, len(m.context + (m.target or "") + m.tail)) for m in made)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="a:\\#<>/turn \n"), st.text(alphabet="a:\\#<>/turn \né")), max_size=4))
def test_escapes_are_reversible(turns):
    import re

    def escaped(text, pattern):
        return re.sub(pattern, r"\\\1", text)

    whole = "".join(f"{chat.OPEN}{escaped(r, chat._ESCAPED_ROLE)}: {escaped(t, chat._ESCAPED)}{chat.CLOSE}\n" for r, t in turns)
    assert chat.parsed(whole) == turns


def test_digests_sum_the_examples(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    placed = chat.stream(chat.segments(df))
    side = [r for r in chat.with_examples(placed).collect() if r.n_turns is not None]
    places = chat.examples(placed).collect()
    assert len(side) == len(places) and {(r.conv_id, r.n_turns, r.n_chars, r.loss_start) for r in side} == {(p.conv_id, p.n_turns, p.n_chars, p.loss_start) for p in places}
    for d in chat.digests(df).collect():
        assert d.formatted_chars == sum(len(m.context + (m.target or "") + m.tail) for m in chat.materialised(placed).collect() if m.conv_id == d.conv_id)
