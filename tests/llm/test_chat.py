import hashlib
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablecare.llm import chat

ROW = "conv_id long, turn long, role string, text string, formatted string, _bytes string, place string"
CONTROLS = ["[INST]", "[/INST]", "</s>", "[ATT]", "[/ATT]", "\\", "[\\INST]", "</s", "[", "ok", "é\U0001f600", "\n", "</s>[INST] ok [/INST]"]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def escaped(s):
    s = s.replace("\\", "\\\\")
    for c in chat.Template().controls:
        s = s.replace(c, c[0] + "\\" + c[1:])
    return s


def brute(rows):
    out = {}
    for c in {r[0] for r in rows}:
        turns = sorted([r for r in rows if r[0] == c], key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", escaped(r[3] or "")))
        said = [((r[2] or ""), (r[3] or "")) for r in turns]
        loss = "".join(t for r, t in said if r == "assistant")
        marks = len("[INST][/INST]</s>")
        out[c] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in said)), len(loss), sha(loss),
                  sum(len(escaped(r)) + len(escaped(t)) + marks for r, t in said))
    return out


def run(spark, rows):
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], ROW).withColumn("parts", chat.text_part(F.col("text")))
    return {r[0]: tuple(r)[1:] for r in chat.digests(chat.read_back(chat.format_chat(df))).collect()}


def test_edges(spark):
    long = "[INST]é\\ " * 60_000
    rows = [(1, 0, "user", None), (1, 1, "assistant", ""), (2, 1, "assistant", long), (2, 0, None, "[/INST]"), (None, None, "system", "a"),
            (None, 0, "assistant", "b"), (3, 0, "user", "x"), (3, 0, "user", "x"), (3, 0, "assistant", "</s>"), (3, 0, "assistant", "<"),
            (4, 0, "[INST]", "role in control strings"), (5, 7, "assistant", "\\")]
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], ROW).withColumn("parts", chat.text_part(F.col("text")))
    assert chat.digests(chat.read_back(chat.format_chat(df))).collect() == []


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 9), st.sampled_from(["user", "assistant", "system", "</s>"]),
                          st.lists(st.sampled_from(CONTROLS), max_size=8).map("".join)), min_size=1, max_size=60))
def test_round_trip(spark, rows):
    assert run(spark, rows) == brute(rows)


def test_parts_of_every_kind(spark):
    visitor = chat.PartVisitor(patch=14, per_second=12.5, per_page=100)
    made = spark.sql(f"""SELECT 1L AS conv_id, 0L AS turn, 'user' AS role, from_json('[
      {{"kind":"text","text":"see [ATT]"}}, {{"kind":"image","ref":"a.png","width":29,"height":14}}, {{"kind":"audio","ref":"b.wav","seconds":3.1}},
      {{"kind":"text","text":null}}, null, {{"kind":"document","ref":"c.pdf","pages":3}}, {{"kind":"vi[INST]deo","ref":"d"}},
      {{"kind":"image","ref":null}}]', 'array<{chat.PART}>') AS parts
      UNION ALL SELECT 1L, 1L, 'assistant', from_json('[{{"kind":"text","text":"a\\\\nb"}},{{"kind":"image","ref":"e","width":14,"height":14}}]', 'array<{chat.PART}>')
      UNION ALL SELECT 1L, 2L, 'user', null""")
    row = chat.read_back(chat.format_chat(made, visitor=visitor)).first()
    assert [tuple(t) for t in row["turns"]] == [
        ("user", "see [ATT]", ["image", "audio", "document", "vi[INST]deo", "image"]), ("assistant", "a\nb", ["image"]), ("user", "", [])]
    assert [tuple(a) for a in row["attachments"]] == [
        ("image", "a.png", 3), ("audio", "b.wav", math.ceil(3.1 * 12.5)), ("document", "c.pdf", 300), ("vi[INST]deo", "d", 1), ("image", None, 1),
        ("image", "e", 1)]
    assert row["formatted"].count("[ATT]") == 6
    assert row["learnt"] == ["a\nb[ATT]image[/ATT]"]


def test_templates_that_could_be_confused_are_refused():
    for bad in ({"turn": "[INST]]["}, {"turn": "aba"}, {"end": "x"}, {"end": "[INST]"}, {"content": "a\\b"}, {"turn": "[INST]!", "content": "[INST]"}):
        with pytest.raises(ValueError):
            chat.Template(**bad)


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, 0, "user", "x", "a", "b", "c")], ROW)
    path = spark.sql("SELECT 1L conv_id, 0L turn, 'user' role, 'x' text").withColumn("parts", chat.text_part(F.col("text")))
    plan = chat.digests(chat.read_back(chat.format_chat(path)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and df.count() == 1
