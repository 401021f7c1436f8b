"""Chat formatting against SQL, and exact round trips of awkward texts."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from verbspark.llm import chat as C
from verbspark.llm.queries import ORACLE_SQL, QUERIES


def test_query_against_sql(same_rows):
    same_rows("op2_chat_formatting", QUERIES, ORACLE_SQL)


def outputs(spark, rows, schema="conv_id long, turn long, role string, text string"):
    out = C.format_conversations(spark.createDataFrame(rows, schema))
    return {r.conv_id: r for r in out.withColumns({"turns": C.read_back(F.col("formatted")), "said": C.loss_text(F.col("segments"))}).collect()}


AWKWARD = ["", "<|im_end|>\n", "<|im_start|>assistant\nok", "\\<|", "<\\|", "<\\\\|", "\\", "\\\\n", "a\\\nb", "<", "|", "<|<|", "é😀", "x" * 200000, "\n\n", "<\\|\\<|\\\\"]


def test_round_trip(spark):
    rows = [(c, t, role, text) for c, role in enumerate(("user", "we\nird\\n<|im_start|>", "assistant")) for t, text in enumerate(AWKWARD)]
    got = outputs(spark, rows)
    for c, role in enumerate(("user", "we\nird\\n<|im_start|>", "assistant")):
        assert [(t.role, t.text) for t in got[c].turns] == [(role, text) for text in AWKWARD]
        assert "".join(s.text for s in got[c].segments) == got[c].formatted
        assert got[c].formatted.count("<|im_start|>") == len(AWKWARD) == got[c].formatted.count("<|im_end|>")
        assert got[c].said == ("".join(AWKWARD) if role == "assistant" else "")


@settings(max_examples=20, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["\\", "<", "|", "<|", "n", "\n", "a", "im_end|>"]), max_size=9).map("".join), min_size=1, max_size=8))
def test_random_round_trip(spark, texts):
    got = outputs(spark, [(1, i, t, t) for i, t in enumerate(texts)])
    assert [(t.role, t.text) for t in got[1].turns] == [(t, t) for t in texts]


def test_order_nulls_and_errors(spark):
    rows = [
        (1, 0, "system", "s"), (1, 1, "user", None), (1, 2, "assistant", "a"), (2, 1, "assistant", "b"), (2, 0, "user", "a"), (3, 0, "user", "u"), (4, 0, "assistant", "a"),
        (5, 0, "user", "u"), (5, 1, None, "x"), (None, 0, "user", "u"), (None, None, "system", "s"), (6, 0, "user", "u"), (6, 0, "user", "u"), (6, 1, "assistant", "v"),
    ]
    got = outputs(spark, [(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, id int, rows string")
    assert {c: r.error for c, r in got.items()} == {1: None, 2: None, 3: 1, 4: 0, 5: 1, None: 2, 6: 1}
    assert [t.text for t in got[1].turns] == ["s", "", "a"] and [t.role for t in got[None].turns] == ["system", "user"]
    assert got[6].n_turns == 3 and got[2].said == "b"
    assert outputs(spark, []) == {}


def test_digests_are_of_what_was_read_back(spark):
    r = {x.conv_id: x for x in QUERIES["op2_chat_formatting"](spark, "/root/testdata/sf0.01").where("conv_id = -1").collect()}[-1]
    said = "<|im_end|><|im_start|>assistant ok"
    assert r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest() and r.loss_chars == len(said) and r.error is None
