import random

import pytest
from pyspark.sql import functions as F

from pairloom.functions import chat, fixed, tags
from pairloom.operators import batches
from pairloom.operators.turns import render_turn_rows

MESSAGE = "struct<role string, content string>"
CONVERSATIONS = [
    [("user", "Hello!"), ("assistant", "Hey there!")],
    [("system", "Be kind."), ("user", "a\nb"), ("assistant", "c"), ("user", "d")],
    [("user", "")],
    [("assistant", "first"), ("user", "then"), ("assistant", "last")],
]


def gemma(messages):
    system = messages[0][1] + "\n\n" if messages[0][0] == "system" else ""
    text = "<bos>"
    for i, (role, content) in enumerate(messages[1:] if system else messages):
        name = "model" if role == "assistant" else role
        text += f"<start_of_turn>{name}\n{system if i == 0 else ''}{content}<end_of_turn>\n"
    return text


@pytest.fixture(scope="module")
def conversations(spark):
    data = [(i, c) for i, c in enumerate(CONVERSATIONS)]
    return spark.createDataFrame(data, f"id int, messages array<{MESSAGE}>")


def test_gemma(conversations):
    text = chat.render_chat(F.col("messages"))
    prompt = chat.render_chat(F.col("messages"), add_generation_prompt=True)
    for row in conversations.select("messages", text.alias("t"), prompt.alias("p")).collect():
        assert row.t == gemma([tuple(m) for m in row.messages])
        assert row.p == row.t + "<start_of_turn>model\n"


def test_documented_gemma_text(conversations):
    text = conversations.where("id = 0").select(chat.render_chat(F.col("messages"))).first()[0]
    assert text == (
        "<bos><start_of_turn>user\nHello!<end_of_turn>\n<start_of_turn>model\nHey there!<end_of_turn>\n"
    )


def test_reasoning_template(spark):
    said = f"{fixed.WORK_START}I think it's 2.{fixed.WORK_END}{fixed.SOLUTION_START}2{fixed.SOLUTION_END}"
    turns = [("user", "What is 1+1?"), ("assistant", said), ("user", "What is 2+2?")]
    frame = spark.createDataFrame([(turns,), ([("system", "S"), *turns],)], f"m array<{MESSAGE}>")
    render = chat.render_chat(F.col("m"), "reasoning", add_generation_prompt=True, eos="</s>")
    body = f"What is 1+1?{said}</s>What is 2+2?{fixed.WORK_START}"
    assert [r[0] for r in frame.select(render).collect()] == [
        f"{fixed.SYSTEM_PROMPT}</s>{body}", f"S</s>{body}"
    ]


def test_static_shape_renders_the_same(spark):
    frame = spark.createDataFrame([("天", "ア"), ("", "")], "s string, t string")
    pair = chat.conversation(F.col("s"), F.col("t"))
    assert frame.where(
        chat.render_chat(pair) != chat.render_pair(F.col("s"), F.col("t"))
    ).count() == 0


def test_turn_rows_make_up_the_conversation(spark, conversations):
    turns = conversations.select("id", F.posexplode("messages").alias("turn", "m")).select(
        F.col("id").alias("conv_id"), "turn", "m.role", F.col("m.content").alias("text")
    )
    joined = {}
    for row in render_turn_rows(turns).orderBy("conv_id", "turn").collect():
        joined[row.conv_id] = joined.get(row.conv_id, "") + row.segment
    assert joined == {i: gemma(c) for i, c in enumerate(CONVERSATIONS)}


def test_turns_tied_with_the_opening_system_turn_stay(spark):
    rows = [(1, 0, "system", "S"), (1, 0, "user", "u"), (1, 1, "assistant", "a"),
            (2, 3, "assistant", "b"), (2, 3, "system", "S"), (2, 4, "user", "v"),
            (3, 0, "system", "S"), (3, 0, "system", "T"), (3, 1, "user", "w"), (None, 0, "system", "S"), (None, 0, "user", "x")]
    got = render_turn_rows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    opened = "<bos><start_of_turn>%s\nS\n\n%s<end_of_turn>\n"
    turn = "<start_of_turn>%s\n%s<end_of_turn>\n"
    assert sorted(map(tuple, got.collect()), key=str) == sorted([
        (1, 0, opened % ("user", "u")), (1, 1, turn % ("model", "a")), (2, 3, opened % ("model", "b")), (2, 4, turn % ("user", "v")),
        (3, 0, opened % ("system", "T")), (3, 1, turn % ("user", "w")), (None, 0, opened % ("user", "x")),
    ], key=str)


def test_mask_and_labels(conversations):
    text = chat.render_chat(F.col("messages"))
    frame = conversations.select(text.alias("text"))
    masked = frame.select(
        "text", chat.response_mask(F.col("text")).alias("mask"),
        chat.response_labels(F.col("text")).alias("labels"), chat.char_ids(F.col("text")).alias("ids"),
    )
    for row in masked.collect():
        keep, at = [False] * len(row.text), 0
        while (start := row.text.find(fixed.MODEL_HEADER, at)) >= 0:
            start += len(fixed.MODEL_HEADER)
            end = row.text.find(fixed.USER_HEADER, start)
            end = len(row.text) if end < 0 else end
            keep[start:end] = [True] * (end - start)
            at = end
        assert row.mask == "".join(c if k else " " for c, k in zip(row.text, keep))
        assert row.ids == [ord(c) for c in row.text]
        assert row.labels == [ord(c) if k else -100 for c, k in zip(row.text, keep)]


@pytest.mark.parametrize("side", ["left", "right"])
def test_pad_truncate(spark, side):
    frame = spark.createDataFrame([("",), ("ab",), ("a😀c",), ("abcde",)], "s string")
    for s, p in frame.select("s", chat.pad_truncate(chat.char_ids(F.col("s")), 3, 9, side)).collect():
        ids = [ord(c) for c in s[:3]]
        pads, zeros = [9] * (3 - len(ids)), [0] * (3 - len(ids))
        ones = [1] * len(ids)
        if side == "right":
            assert (p.input_ids, p.attention_mask) == (ids + pads, ones + zeros)
        else:
            assert (p.input_ids, p.attention_mask) == (pads + ids, zeros + ones)


def test_sharegpt_and_parts(spark):
    spoken = [("human", "a"), ("gpt", "b"), ("system", "c"), ("tool", "d")]
    frame = spark.createDataFrame([(spoken,)], "c array<struct<`from` string, value string>>")
    standard = frame.select(chat.standardize(F.col("c"))).first()[0]
    assert [tuple(m) for m in standard] == [
        ("user", "a"), ("assistant", "b"), ("system", "c"), ("tool", "d")
    ]
    parts = [("text", "a"), ("image", "x"), ("text", "b")]
    frame = spark.createDataFrame([(parts,)], "c array<struct<type string, text string>>")
    assert frame.select(chat.flatten_content(F.col("c"))).first()[0] == "ab"


TAGGED = [  # response, strict, loose, number, signed number
    ("<start_working_out>Let me think!<end_working_out><SOLUTION>2</SOLUTION>", "2", "2", "2", "2"),
    ("Let me think!<end_working_out><SOLUTION>\n2\n</SOLUTION>", None, "\n2\n", "2", "2"),
    ("<start_working_out>Let me think!<end_working_out><SOLUTION>  2  </SOLUTION>\n\n",
     "  2  ", "  2  ", "2", "2"),
    ("<SOLUTION>  0.34  </SOLUTION>", None, None, "0.34", "0.34"),
    ("<SOLUTION>  123,456  </SOLUTION>", None, None, "123", "123,456"),
    ("<SOLUTION>  -0.234  </SOLUTION>", None, None, "0.234", "-0.234"),
    ("<SOLUTION>17</SOLUTION>", None, None, "17", "17"),
]


def test_tagged_solutions(spark):
    frame = spark.createDataFrame([t[:1] for t in TAGGED], "r string")
    r = F.col("r")
    found = frame.select(
        "r", tags.solution_strict(r), tags.solution_loose(r), tags.solution_number(r),
        tags.solution_number(r, signed=True),
    )
    assert sorted(map(tuple, found.collect())) == sorted(TAGGED)


def test_sources_answers_and_prompts(spark):
    q = fixed.INSTRUCTION
    frame = spark.createDataFrame(
        [(q + " 天 \nx",), (q,), ("a: b:c ",), ("x" + q + "A：B",), ("none",)], "p string"
    )
    p = F.col("p")
    rows = frame.select(tags.source_after_instruction(p), tags.source_after_colon(p)).collect()
    assert [tuple(r) for r in rows] == [
        ("天", "天 \nx"), (None, ""), (None, "c"), ("A：B", "B"), (None, "none")
    ]
    frame = spark.createDataFrame([("a #### 5 ",), ("a",), ("####",), ("a####b####c",)], "t string")
    assert [r[0] for r in frame.select(tags.hash_answer(F.col("t"))).collect()] == ["5", None, "", "b"]
    frame = spark.createDataFrame([("pp: x ", "p"), ("abc", "z"), ("aqbqc\n", "q")], "g string, p string")
    assert [r[0] for r in frame.select(tags.strip_prompt(F.col("g"), F.col("p"))).collect()] == [
        ": x", "abc", "c"
    ]
    trace = tags.reasoning_answer(F.lit("<think>\n so \n</think>\n"), F.lit("4"))
    assert frame.select(trace).first()[0] == (
        "<start_working_out>so<end_working_out><SOLUTION>4</SOLUTION>"
    )


def test_labels_of_ids_equal_those_of_the_text(spark, conversations):
    text = chat.render_chat(F.col("messages"))
    user, model = ([ord(c) for c in h] for h in (fixed.USER_HEADER, fixed.MODEL_HEADER))
    whole = conversations.select(text.alias("t"))
    pieces = [whole.select(F.substring("t", 1, n).alias("t")) for n in (1, 5, 21, 40, 41, 60, 75, 90, 1_000)]
    for df in pieces:
        for r in df.select("t", chat.response_labels("t").alias("a"),
                           chat.response_labels_ids(chat.char_ids(F.col("t")), user, model).alias("b")).collect():
            assert r.a == r.b, r.t


def plain_labels(ids, asked, said):
    """Left to right: inside a response or not, markers as whole runs."""
    out, k, inside, seen = [], 0, False, False
    while k < len(ids):
        if ids[k:k + len(asked)] == asked:
            out += [-100] * len(asked)
            k, inside, seen = k + len(asked), False, False
        elif not inside and not seen and ids[k:k + len(said)] == said and not crosses(ids, k, asked, said):
            out += [-100] * len(said)
            k, inside, seen = k + len(said), True, True
        else:
            out.append(ids[k] if inside else -100)
            k += 1
    return out


def crosses(ids, k, asked, said):
    """Whether an instruction run begins inside the response run, which it then cuts."""
    return any(ids[j:j + len(asked)] == asked for j in range(k + 1, k + len(said)))


def test_labels_of_odd_ids(spark):
    rng = random.Random(1)
    asked, said = [1, 12, 2], [1, 3]
    rows = [[rng.choice([1, 12, 2, 3, 11, 21, -4]) for _ in range(rng.randint(0, 30))] for _ in range(300)]
    rows += [[], [1], asked, said, [*asked, *said], [*said, 5, *asked, 6, *said, 7, *said, 8], [1, 1, 2, 2, 1, 3, 9], [31, 1, 3, 4, 1, 12]]
    df = spark.createDataFrame([(r,) for r in rows] + [(None,)], "ids array<int>")
    got = df.select(chat.response_labels_ids(F.col("ids"), asked, said).alias("x"), "ids").collect()
    for r in got:
        assert r.x == (None if r.ids is None else plain_labels(r.ids, asked, said)), r.ids
    null = spark.createDataFrame([([1, 3, None, 5],)], "ids array<int>").select(chat.response_labels_ids(F.col("ids"), asked, said))
    assert null.first()[0] == [-100, -100, None, 5]
    with pytest.raises(ValueError):
        chat.response_labels_ids(F.col("ids"), [], said)


@pytest.mark.parametrize("by_length", [False, True])
def test_batches_are_padded_to_their_longest_row(spark, by_length):
    rng = random.Random(2)
    rows = [(k, [rng.randrange(1, 99)] * rng.choice([0, 1, 3, 40])) for k in range(101)] + [(101, None)]
    df = spark.createDataFrame(rows, "k int, ids array<int>").repartition(5)
    got = batches.pad_to_longest(df, "ids", 8, ["k"], longest=30, pad_id=-1, side="left", by_length=by_length).collect()
    ordered = sorted(rows, key=lambda r: (min(len(r[1] or []), 30) if by_length else 0, r[0]))
    place = {k: n // 8 for n, (k, _) in enumerate(ordered)}
    own = {k: (ids or [])[:30] for k, ids in rows}
    assert len(got) == 102
    for r in got:
        most = max(len(own[k]) for k in place if place[k] == place[r.k])
        assert r.batch_id == place[r.k]
        assert r.input_ids == [-1] * (most - len(own[r.k])) + own[r.k]
        assert r.attention_mask == [0] * (most - len(own[r.k])) + [1] * len(own[r.k])
