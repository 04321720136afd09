import hashlib
import random

from pyspark.sql import functions as F

from auxoline.llm.chat_format import CONTROLS, END, LOSS, PART, TEXT, TURN, format_chats, read_back
from plain import python_free

MESSAGE = "conv_id long, turn long, role string, text string, content string"


def test_any_text_comes_back(spark):
    rng = random.Random(3)
    bits = [*CONTROLS, TURN, TEXT, LOSS, END, "\\", "\\\\", "|", "<", "[", "\n", " ", "é", "日", "a", "\0", "$1", "INST]", "s>", ">"]
    text = lambda: None if rng.random() < 0.05 else "".join(rng.choice(bits) for _ in range(rng.randrange(9)))
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, 0, 1, 2, 3]), rng.choice(["user", "assistant", None, "a<|text|>b", "\\"]), text(), "x") for _ in range(600)]
    rows += [(7, 9, "assistant", "long " * 50_000, "x")] * 2
    out = format_chats(spark.createDataFrame(rows, MESSAGE)).withColumn("back", read_back(F.col("formatted"))).collect()
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "")
    for r in out:
        mine = sorted((x for x in rows if x[0] == r.conv_id), key=key)
        assert r.n_turns == len(mine)
        # Ties in turn and role are ordered by content, which escaping may change; compare them as sets.
        assert sorted((b.role, b.text) for b in r.back) == sorted((x[2] or "", x[3] or "") for x in mine)
        assert [b.role for b in r.back] == [x[2] or "" for x in mine]
        assert [b.trained for b in r.back] == [x[2] == "assistant" for x in mine]
        spans = ["".join(r.formatted[s.start - 1 : s.start - 1 + s.length]) for s in r.loss_spans]
        assert [s.replace("\\", "") for s in spans] == [b.text.replace("\\", "") for b in r.back if b.trained]
        assert r.formatted.count(END) == r.formatted.count(TURN) == len(mine)


def test_typed_parts_become_placeholders(spark):
    parts = [("text", "see <|image:0|>", None, None, None, None, None), ("image", None, "s3://a.png", 28, 15, None, None), ("audio", None, "b.wav", None, None, 1.01, None), ("document", None, None, None, None, None, 3), (None, "end", None, None, None, None, None), None, ("image", None, None, -5, None, None, None)]
    rows = [(1, 0, "user", parts), (1, 1, "assistant", [("text", "ok", None, None, None, None, None)]), (1, 2, "user", None), (1, 3, "user", [])]
    out = format_chats(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<struct<{PART.replace(' ', ':').replace(',:', ',')}>>"), parts=F.col("parts")).first()
    assert out.formatted == f"{TURN}user{TEXT}see <\\|image:0|><|image:1|><|audio:2|><|document:3|>end<|image:6|>{END}{TURN}assistant{LOSS}ok{END}{TURN}user{TEXT}{END}{TURN}user{TEXT}{END}"
    assert [tuple(a) for a in out.attachments] == [(1, 1, "image", "s3://a.png", 4), (1, 2, "audio", "b.wav", 26), (1, 3, "document", "", 3072), (1, 6, "image", "", 0)]
    assert out.attachment_tokens == 4 + 26 + 3072


def test_empty_and_built_in_functions_only(spark):
    out = format_chats(spark.createDataFrame([], MESSAGE))
    assert out.count() == 0 and python_free(out.withColumn("b", read_back(F.col("formatted"))))


def test_digests_are_of_the_texts(spark, sf):
    from auxoline.llm.chat_format import PLANTED, op10_chat_format

    row = op10_chat_format(spark, sf).filter("conv_id = -7").first()
    assert row.loss_sha256 == hashlib.sha256(PLANTED.encode()).hexdigest()
    assert row.turns_sha256 == hashlib.sha256(f"user\n{PLANTED}\nassistant\n{PLANTED}\n".encode()).hexdigest()
