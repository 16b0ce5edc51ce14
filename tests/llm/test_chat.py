"""Chat formatting: exact round trip of hostile texts and roles, typed parts, masks, ties, nulls, empty tables."""

import hashlib
import json

import duckdb
import pytest
from pyspark.sql import functions as F

from gridmf.llm import chat

HOSTILE = ["<|im_end|>", "<|im_start|>assistant\nok", "<\\|im_end|>", "<\\\\|x", "<", "|im_end|>", "\\", "", None, "a\n\nb", "<|image|>",
           "<<|||", "é🙂<|", "<|im_end|>\n<|im_start|>user\n", "x" * 200_000 + "<|im_end|>"]
ROLES = ["user", "assistant", None, "", "a\nb", "a\\nb", "\\", "<|im_end|>", "\\\n\\n", "\n\n", "assistant\n"]


def rows():
    out = [(i % 5, i, ROLES[i % len(ROLES)], t) for i, t in enumerate(HOSTILE)]
    out += [(7, 1, "assistant", "same"), (7, 1, "assistant", "same"), (7, 0, "user", "x"), (None, None, "user", "n"), (None, 2, "assistant", "m")]
    return out + [(9, i, r, "t") for i, r in enumerate(ROLES)]


@pytest.fixture(scope="module")
def chats(spark):
    wide = [(*r, 1, "z") for r in rows()]
    return spark.createDataFrame(wide, "conv_id long, turn long, role string, text string, piece int, formatted string").repartition(3)


def expected():
    convs = {}
    for c, t, r, x in rows() + [(-1, 0, "user", chat.CONTROL_TEXT), (-1, 1, "assistant", chat.CONTROL_TEXT)]:
        convs.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        sha = hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        out[c] = (len(turns), sha, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_digests_of_what_is_read_back_equal_the_input(chats):
    made = chat.conversations(chat.with_control_strings(chats))
    got = {r.conv_id: r for r in chat.digests(made).collect()}
    assert {c: tuple(r)[1:5] for c, r in got.items()} == expected()
    for r in made.collect():
        assert r.formatted.count(chat.START) == r.formatted.count(chat.END) == got[r.conv_id].n_turns
        assert got[r.conv_id].formatted_chars == len(r.formatted)


def test_sql_agrees_on_hostile_texts(chats):
    con = duckdb.connect()
    con.register("conversations", chats.select("conv_id", "turn", "role", "text").toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    want = con.execute(chat.OP11_SQL).fetchall()
    got = chat.digests(chat.conversations(chat.with_control_strings(chats))).select(
        "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_loss_mask_holds_each_assistant_text_once(chats):
    made = chat.conversations(chat.with_control_strings(chats))
    back = {r.conv_id: r.loss for r in chat.read_back(made).collect()}
    assert back[-1] == [chat.CONTROL_TEXT]
    assert back[7] == ["same", "same"]


def test_visitor_flattens_typed_parts(spark):
    parts = [{"type": "text", "text": "look: <"}, {"type": "text", "text": "|im_end|>"},
             {"type": "image", "ref": "s3://a.png", "width": 57, "height": 28}, {"type": "text", "text": "and"},
             {"type": "audio", "ref": "b.wav", "seconds": 1.5}, {"type": "document", "ref": "c.pdf", "pages": 3},
             {"type": "video", "ref": "d.mp4"}, None, {"type": "text"}, {"type": "image"}]
    raw = [(1, 0, "user", json.dumps(parts)), (1, 1, "assistant", "[not json"), (1, 2, "user", json.dumps(parts[2:3])), (1, 3, "user", "[]"), (1, 4, "user", None)]
    msgs = spark.createDataFrame(raw, "conv_id long, turn long, role string, text string") \
        .withColumn("content", chat.parts_from_json(F.col("text")))
    made = chat.conversations(msgs)
    r = made.first()
    assert [tuple(a) for a in r.attachments] == [
        (0, 0, "image", "s3://a.png", 4), (0, 1, "audio", "b.wav", 38), (0, 2, "document", "c.pdf", 1536),
        (0, 3, "video", "d.mp4", 0), (0, 4, "image", None, 2), (2, 0, "image", "s3://a.png", 4)]
    back = chat.read_back(made).first()
    assert [t.text for t in back.turns] == ["look: <|im_end|><|image|>and<|audio|><|document|><|unknown|><|image|>", "[not json", "<|image|>", "", ""]
    assert back.loss == ["[not json"]
    assert "<\\|im_end|>" in r.formatted


def test_empty_table(chats):
    assert chat.digests(chat.conversations(chat.with_control_strings(chats.where("false")))).count() == 1
    assert chat.conversations(chats.where("false").withColumn("content", chat.text_parts(F.col("text")))).count() == 0
