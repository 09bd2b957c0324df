import pandas as pd
import pytest
from latticework.llm import op1_chat as m

from .helpers import oracle, of, write

ROWS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "\\h \\ ### </turn>\n</turn>\n### user\nx"), (1, 2, "user", None), (1, 3, "assistant", ""),
    (2, 0, "system", "only \n"), (3, 5, None, "no role"), (3, 5, "assistant", "tie"), (3, 5, "assistant", "tie"), (3, None, "a\nb", "first"),
    (4, 0, "assistant", "### Assistant: é😀" * 500), (None, 0, "user", "x"), (None, 1, "assistant", "y"), (5, 1, "assistant", "\\"), (5, 0, "assistant", "</turn"), (5, 2, "user", "/turn>"),
]
SCHEMA = "conv_id long, turn long, role string, text string"


def test_table(spark):
    assert of(m.op1_chat(spark, "/root/testdata/sf0.001")) == oracle(m.SQL)


def test_odd_rows(spark, tmp_path):
    df = spark.createDataFrame([(*r, "x", 1) for r in ROWS], SCHEMA + ", example string, formatted int")
    got = of(m.op1_chat(spark, write(spark, tmp_path, conversations=df)))
    assert got == oracle(m.SQL, conversations=pd.DataFrame(ROWS, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))


def test_examples(spark):
    df = spark.createDataFrame(ROWS[:4], SCHEMA)
    made = sorted(m.examples(df).collect(), key=lambda r: r.example)
    assert len(made) == 2
    assert made[0].text[made[0].loss_start : made[0].loss_end].count("</turn>") == 0
    assert made[1].text.startswith(made[0].text) and made[1].loss_start == made[1].loss_end
    assert m.examples(df.limit(0)).count() == 0


def test_many_turns(spark, tmp_path):
    rows = [(1, i, "assistant" if i % 2 else "user", f"turn {i} \\n é") for i in range(900)]
    df = spark.createDataFrame(rows, SCHEMA)
    made = m.examples(df).collect()
    assert len(made) == 450 and all(r.text[r.loss_start : r.loss_end] == m_escape(rows[2 * r.example + 1][3]) for r in made)
    assert of(m.op1_chat(spark, write(spark, tmp_path, conversations=df))) == oracle(m.SQL, conversations=pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]))


def m_escape(text):
    return text.replace("\\", "\\b").replace("###", "\\h")


def test_native():
    source = open(m.__file__).read()
    assert not any(x in source for x in ("pandas_udf", "mapIn", "applyIn", ".rdd", "F.udf"))


if __name__ == "__main__":
    pytest.main([__file__, "-q"])
