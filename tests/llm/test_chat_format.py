"""Operator 12: exact round trips, the machine against a plain walk, and its equal in SQL."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from pathlib import Path

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.llm import queries as Q
from tidelog.llm._common import table
from tidelog.llm.chat_format import ChatTemplate, Role, digests, format_conversations, read_loss, read_turns

SCHEMA = "conv_id long, turn long, role string, text string"
TEMPLATE = ChatTemplate()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(rows):
    """{conv_id: what op12 returns}, from the turns alone."""
    talks = defaultdict(list)
    for r in rows:
        talks[r[0]].append((r[1], r[2], r[3] or ""))
    out = {}
    for c, turns in talks.items():
        turns.sort(key=lambda t: tuple((v is not None, v) for v in t))
        state, bad = "start", None
        for k, (_, role, _) in enumerate(turns):
            following = TEMPLATE.moves.get(state, {}).get(role)
            if following is None:
                bad = k
                break
            state = following
        if bad is None and state not in TEMPLATE.ends:
            bad = len(turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r or ''}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss), bad is None, bad)
    return out


def shown(rows):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.valid, r.bad_turn) for r in rows}


def test_chat_format(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect()]
    said = "\\### Assistant: </turn> ok"
    got = Q.op12_chat_format(spark, sf_dir).collect()
    assert shown(got) == brute([*rows, (-7, 0, "user", said), (-7, 1, "assistant", said)])
    assert [r.loss_chars for r in got if r.conv_id == -7] == [len(said)]


def test_chat_format_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{Path(sf_dir) / 'conversations.parquet'}'")
    found = con.execute(Q.OP12_SQL)
    names = [d[0] for d in found.description]
    df = Q.op12_chat_format(spark, sf_dir)
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(names).collect())) == sorted(found.fetchall())


def test_no_python_in_the_plan(spark, sf_dir):
    plan = Q.op12_chat_format(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange") <= 2


ODD_TEXTS = ["", None, "\\", "\\\\e", "\\e", "\\A", "### ", "###", " : ", "x:", ": ", "</turn>", "</turn", "</turn>\n", "<</turn>/turn>", "\\### Assistant: </turn> ok", "\n", "é😀", "a" * 100_000, "\\E\\Q.*", "$1"]


def test_round_trip_of_odd_turns(spark):
    rows = [(k, t, role, text) for k, text in enumerate(ODD_TEXTS) for t, role in enumerate(["system", "user", "assistant", "user"])]
    rows += [(1000 + k, 0, role, "t") for k, role in enumerate([None, "", "tool", "User", "?", "\\n", ": ", "### x</turn>\n", "assistant "])]
    rows += [(None, 0, "user", "q"), (None, 1, "assistant", "a"), (2000, None, "user", "null turn"), (2000, 1, "assistant", "b"), (2001, 1, "user", "same"), (2001, 1, "user", "same"), (2002, 1, "user", "b"), (2002, 1, "assistant", "a")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", segments int, formatted string")
    made = format_conversations(df)
    assert shown(digests(made).collect()) == brute(rows)
    back = made.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("segments")).alias("loss"), F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("whole"), "segments").collect()
    for r in back:
        assert r.whole == r.formatted
        own = sorted(((x[1], x[2], x[3] or "") for x in rows if x[0] == r.conv_id), key=lambda t: tuple((v is not None, v) for v in t))
        assert [(t.role, t.text) for t in r.turns] == [(role, text) for _, role, text in own]
        assert [s.loss for s in r.segments] == [x for _, role, _ in own for x in (False, role == "assistant", False)]
    assert format_conversations(df.limit(0)).collect() == []


@pytest.fixture(scope="module")
def trip(spark):
    def go(texts):
        df = spark.createDataFrame([(0, k, "user", t) for k, t in enumerate(texts)], SCHEMA)
        return [t.text for t in format_conversations(df).select(read_turns(F.col("formatted")).alias("turns")).first().turns]

    return go


@settings(max_examples=12, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["\\", "e", "A", "B", "C", "n", "#", "### ", ":", " ", "<", "</turn>", "\n", "?", "é"]), max_size=12).map("".join), min_size=1, max_size=30))
def test_any_text_comes_back(trip, texts):
    assert trip(texts) == texts


@pytest.mark.parametrize(
    ("roles", "bad"),
    [("ua", None), ("u", None), ("sua", None), ("s", 1), ("a", 0), ("uu", 1), ("uau", None), ("usa", 1), ("uaa", 2), ("su", None), ("ss", 1), ("uas", 2), ("uxa", 1)],
)
def test_turn_order(spark, roles, bad):
    of = {"u": "user", "a": "assistant", "s": "system", "x": "tool"}
    df = spark.createDataFrame([(1, k, of[r], "t") for k, r in enumerate(roles)], SCHEMA)
    row = format_conversations(df).first()
    assert (row.valid, row.bad_turn) == (bad is None, bad)
    assert format_conversations(df, invalid="drop").count() == (bad is None)


def test_another_template(spark):
    template = ChatTemplate({"q": Role("Q"), "a": Role("A", loss=True), "tool": Role("T", loss=True)}, "[", "]", "[end]", ("[", "]"), "%", "0", {"0": {"q": "1"}, "1": {"a": "0", "tool": "1"}}, ("0",))
    df = spark.createDataFrame([(1, 0, "q", "a%[b]"), (1, 1, "tool", "[end]"), (1, 2, "a", "x")], SCHEMA)
    row = format_conversations(df, template).withColumn("turns", read_turns(F.col("formatted"), template)).withColumn("loss", read_loss(F.col("segments"), template)).first()
    assert row.formatted == "[Q]a%e%Ab%B[end][T]%Aend%B[end][A]x[end]" and row.valid and row.loss == "[end]x"
    assert [tuple(t) for t in row.turns] == [("q", "a%[b]"), ("tool", "[end]"), ("a", "x")]


@pytest.mark.parametrize("wrong", [{"control": ("### ", ": ")}, {"control": ("### ", ": ", "</turn>", "abca")}, {"control": ("### ", ": ", "</turn>", "> ")}, {"escape": ""}, {"roles": {"a": Role("?x")}}, {"roles": {"a": Role("X"), "b": Role("X")}}])
def test_templates_that_cannot_be_read_back(wrong):
    with pytest.raises(ValueError):
        ChatTemplate(**wrong)
