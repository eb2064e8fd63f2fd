"""Conversations, rewards and gates against plain models of their rules."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomtrail.operators import conversation as C
from loomtrail.operators import gates as G
from loomtrail.operators import rewards as W

SCHEMA = "traj_id bigint, messages array<struct<role:string,content:array<struct<type:string,text:string>>,tool_calls:array<struct<type:string,id:string,function:struct<name:string,arguments:string>>>,tool_call_id:string,name:string>>, references array<string>"


def msg(role, text="x", calls=None, result=None, name=None):
    return (role, None if text is None else [("text", text)], calls and [("function", i, (n, "{}")) for i, n in calls], result, name)


def frame(spark, *conversations):
    return spark.createDataFrame([(k, c, ["4"]) for k, c in enumerate(conversations)], SCHEMA)


ERR = "Traceback (most recent call last)"


def asks(i, text="<think>a</think><tool_call>{}</tool_call>"):
    return msg("assistant", text, [(f"c{i}", "crop")])


def test_violations_in_order(spark):
    good = [msg("user"), msg("assistant", "", [("c", "crop")]), msg("tool", "r", None, "c", "crop"), msg("assistant", "done")]
    cases = [
        (good, None),
        (good[:1] + good[2:], "messages[1] has no matching pending tool call"),
        (good[:2], "trajectory ends with unmatched tool calls"),
        (good[:3], "trajectory has no final assistant answer"),
        ([msg("robot")], "messages[0].role is invalid"),
        ([msg("user", None)], "messages[0].content must be a content-part list"),
        ([msg("user", "x", [("c", "crop")])], "messages[0] has tool_calls outside an assistant turn"),
        (good[:2] + [msg("tool", "r", None, "c", "visit")], "messages[2] tool name does not match"),
        ([msg("assistant", "", [("c", "crop"), ("c", "crop")])], "messages[0].tool_calls[1] has an invalid id"),
        ([], "messages must be a non-empty list"),
        (None, "messages must be a non-empty list"),
    ]
    got = frame(spark, *[c for c, _ in cases]).select("traj_id", C.first_violation(F.col("messages")).alias("e")).collect()
    assert {r["traj_id"]: r["e"] for r in got} == {k: e for k, (_, e) in enumerate(cases)}
    row = frame(spark, good)
    assert row.select(C.first_violation(F.col("messages"), F.array(F.lit("visit")))).first()[0] == "messages[1] calls undefined tool"
    assert "placeholder count 0 does not match images count 1" in row.select(C.first_violation(F.col("messages"), None, F.array(F.lit("i")))).first()[0]


def plain_fatal(messages):
    """The rule in plain words: count errors of consecutive assistant turns."""
    run, start = 0, None
    for k, m in enumerate(messages):
        if m[0] != "assistant":
            continue
        bad = k + 1 < len(messages) and messages[k + 1][0] == "tool" and "traceback" in messages[k + 1][1][0][1].lower()
        if bad:
            start = k if run == 0 else start
            run += 1
            if run == 3:
                return start
        else:
            run = 0
    return None


conv = st.lists(st.sampled_from(["a", "ok", "err", "user"]), max_size=14).map(lambda ks: [{"a": asks(0), "ok": msg("tool", "fine"), "err": msg("tool", ERR), "user": msg("user")}[k] for k in ks])


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(conv, min_size=1, max_size=25))
def test_fatal_cut_equals_plain_model(spark, conversations):
    got = {r["traj_id"]: r["cut"] for r in C.fatal_cut(frame(spark, *conversations)).collect()}
    assert got == {k: plain_fatal(c) for k, c in enumerate(conversations)}


def test_fatal_cases(spark):
    bad = [asks(0), msg("tool", ERR)]
    ok = [asks(0), msg("tool", "fine")]
    end = [msg("assistant", "<think>t</think><response>4</response>")]
    got = {r["traj_id"]: (r["cut"], r["fatal"]) for r in C.fatal_cut(frame(spark, bad * 3 + end, bad * 2 + ok + bad + end, ok, ok + bad * 3)).collect()}
    assert got == {0: (0, True), 1: (None, False), 2: (None, True), 3: (2, True)}


def test_reward_golden(spark):
    turns = [msg("user", "q"), asks(0), msg("tool", "fine", None, "c0", "crop"), msg("assistant", "<think>t</think><response> 4 </response>")]
    plain = [msg("user", "q"), msg("assistant", "4")]
    v = spark.createDataFrame([(0, 0.0, 0.5), (1, 1.0, 1.0)], "traj_id bigint, accuracy double, utility double")
    got = {r["traj_id"]: r for r in W.scores(frame(spark, turns, plain), v).collect()}
    assert got[0]["total"] == pytest.approx(0.9) and got[0]["accuracy"] == 1.0 and got[0]["format"] == 1.0
    assert got[1]["total"] == 0.0 and got[1]["fatal"] == 1.0
    assert W.batch_means(W.scores(frame(spark, turns, plain), v)).first()["total"] == pytest.approx(0.45)


def test_fatal_keeps_utility(spark):
    ok = [asks(0), msg("tool", "fine")]
    v = spark.createDataFrame([(0, 1.0, 0.5)], "traj_id bigint, accuracy double, utility double")
    r = W.scores(frame(spark, ok + [asks(1), msg("tool", ERR)] * 3), v).first()
    assert (r["fatal"], r["accuracy"], r["total"]) == (1.0, 0.0, pytest.approx(0.1))


def test_conversion_pairs_calls(spark):
    call = '<tool_call>{"name": "crop", "arguments": {"a": 1}}</tool_call>'
    rows = [(1, 0, "human", "<image>q"), (1, 1, "gpt", f"<think>t</think>{call}"), (1, 2, "observation", "r"), (1, 3, "gpt", "done"), (2, 0, "human", "q"), (2, 1, "observation", "r"), (3, 0, "gpt", call), (4, 0, "gpt", call), (4, 1, "gpt", call), (4, 2, "tool", "r")]
    df = spark.createDataFrame(rows, "row_id bigint, turn bigint, from string, value string")
    got = {r["row_id"]: r for r in C.convert_sft(df).collect()}
    m = got[1]["messages"]
    assert got[1]["error"] is None and m[1]["tool_calls"][0]["id"] == m[2]["tool_call_id"] == "call-1" and m[2]["name"] == "crop"
    assert [p["type"] for p in m[0]["content"]] == ["image", "text"] and m[1]["content"][0]["text"] == "<think>t</think>"
    assert got[2]["error"] == "tool result has no preceding tool call"
    assert got[3]["error"] == "trajectory ends before its tool result"
    assert got[4]["error"] == "a call overwrites an open one"
    assert {r["row_id"]: r["error"] for r in C.convert_sft(df, strict=False).collect()}[4] is None


def test_rl_part_order(spark):
    df = spark.createDataFrame([("q", ["a"], ["i", "j"], None)], "question string, answer array<string>, images array<string>, dataset string")
    r = C.convert_rl(df, "sys").first()
    assert [p["type"] for p in r["prompt"][1]["content"]] == ["image", "image", "text"] and r["dataset"] == "unknown"


def test_gates(spark):
    df = spark.createDataFrame([("In the image, who?", "A b"), ("In the image, who?", " "), ("image", "a b c d e f g"), ("image", " None. "), ("who?", "x"), (None, None)], "q string, a string")
    assert [r[0] for r in df.select(G.answer_reason(F.col("q"), F.col("a"))).collect()] == [None, "empty question or answer", "answer exceeds six tokens", "answer is generic", "source anchor is not visual", "empty question or answer"]
    leak = spark.createDataFrame([("Where is Fort-Knox?", ["fort knox"]), ("a party", ["art"]), ("a party", ["", "??", None]), (None, ["x"])], "q string, h array<string>")
    assert [r[0] for r in leak.select(G.leaked(F.col("q"), F.col("h"))).collect()] == [True, True, False, False]
    v = spark.createDataFrame([(True, True), (True, None), (False, True)], "a boolean, b boolean")
    assert [r[0] for r in v.select(G.all_true([F.col("a"), F.col("b")])).collect()] == [True, False, False]


def test_attempts(spark):
    df = spark.createDataFrame([(1, 1, "x", False), (1, 2, "y", None), (1, 3, "z", True), (1, 4, "w", True), (2, 1, "q", False)], "s int, n int, a string, ok boolean")
    assert [tuple(r) for r in G.first_accepted(df, "s", ["n"], "ok").collect()] == [(1, 3, "z", True)]
    assert {(r["s"], r["n"]): r["avoid"] for r in G.avoid_lists(df, "s", ["n"], "a", "ok").collect()}[1, 3] == ["x", "y"]
