"""Operators on conversations: arrays of messages with content parts and tool calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

ROLES = ("system", "user", "assistant", "tool")


def turns(rows: DataFrame, key: str = "traj_id") -> DataFrame:
    """(key, turn, role, content, tool_calls, tool_call_id, name, text): a row for each message, turn from 0; null messages have none."""
    t = rows.select(key, F.posexplode("messages").alias("turn", "m"))
    return t.select(key, F.col("turn").cast("bigint").alias("turn"), "m.role", "m.content", "m.tool_calls", "m.tool_call_id", "m.name", T.parts_text(F.col("m.content")).alias("text"))


def calls(rows: DataFrame, key: str = "traj_id") -> DataFrame:
    """(key, turn, call_no, call_id, name, arguments) of each tool call."""
    c = turns(rows, key).select(key, "turn", F.posexplode("tool_calls").alias("call_no", "c"))
    return c.select(key, "turn", F.col("call_no").cast("bigint").alias("call_no"), F.col("c.id").alias("call_id"), F.col("c.function.name").alias("name"), F.col("c.function.arguments").alias("arguments"))


def unmatched(rows: DataFrame, key: str = "traj_id") -> DataFrame:
    """(key, turn, kind) of calls without a later result of their id, and of results without an earlier call."""
    c = calls(rows, key).select(key, F.col("turn").alias("call_turn"), "call_id")
    r = turns(rows, key).where("role = 'tool'").select(key, F.col("turn").alias("result_turn"), F.col("tool_call_id").alias("call_id"))
    after = F.col("result_turn") > F.col("call_turn")
    on = (c[key] == r[key]) & (c.call_id == r.call_id) & after
    lone_calls = c.join(r, on, "left_anti").select(key, F.col("call_turn").alias("turn"), F.lit("call").alias("kind"))
    lone_results = r.join(c, on, "left_anti").select(key, F.col("result_turn").alias("turn"), F.lit("result").alias("kind"))
    return lone_calls.unionByName(lone_results)


def observations(rows: DataFrame, key: str = "traj_id") -> DataFrame:
    """(key, turn, next_role, next_text, is_error) of each assistant turn: the message right after it, and whether it is a failed tool result."""
    w = Window.partitionBy(key).orderBy("turn")
    t = turns(rows, key).withColumn("next_role", F.lead("role").over(w)).withColumn("next_text", F.lead("text").over(w))
    t = t.where("role = 'assistant'")
    return t.select(key, "turn", "text", "tool_calls", "next_role", "next_text", ((F.coalesce(F.col("next_role"), F.lit("")) == "tool") & T.is_error_observation(F.col("next_text"))).alias("is_error"))


def error_runs(ordered: DataFrame, key: str, order: list[str], error: str, least: int = 3) -> DataFrame:
    """(key, first, length): runs of least or more errors one after the other; first is the position (from 1) of the run's first row among the key's rows."""
    w = Window.partitionBy(key).orderBy(*order)
    t = ordered.withColumn("pos", F.row_number().over(w).cast("bigint")).withColumn("island", F.sum(F.when(F.col(error), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return t.where(error).groupBy(key, "island").agg(F.min("pos").alias("first"), F.count("*").alias("length")).where(F.col("length") >= least).select(key, "first", "length")


def fatal_cut(rows: DataFrame, key: str = "traj_id", least: int = 3) -> DataFrame:
    """(key, cut, fatal): the turn at which a conversation is cut: the first of least assistant turns in a row whose tool results are errors (null: not cut); fatal also without a final answer."""
    o = observations(rows, key)
    w = Window.partitionBy(key).orderBy("turn")
    runs = (
        o.withColumn("island", F.sum(F.when(F.col("is_error"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .where("is_error")
        .groupBy(key, "island")
        .agg(F.min("turn").alias("cut"), F.count("*").alias("n"))
        .where(F.col("n") >= least)
        .groupBy(key)
        .agg(F.min("cut").alias("cut"))
    )
    every = rows.select(key).distinct()
    answers = final_answers(rows, key).select(key, "answer")
    return every.join(runs, key, "left").join(answers, key, "left").select(key, "cut", (F.col("cut").isNotNull() | (F.coalesce("answer", F.lit("")) == "")).alias("fatal"))


def final_answers(rows: DataFrame, key: str = "traj_id") -> DataFrame:
    """(key, answer): the response block of the last assistant message without tool calls that has one; keys without one are left out."""
    t = turns(rows, key).where("role = 'assistant' and coalesce(size(tool_calls), 0) <= 0").withColumn("answer", T.response_block(F.col("text"))).where("answer is not null")
    return t.groupBy(key).agg(F.max_by("answer", "turn").alias("answer"))


def format_scores(rows: DataFrame, key: str = "traj_id") -> DataFrame:
    """(key, turns, format): the mean over assistant turns of 1 for a well-formed turn whose tool result is no error; 0 without turns."""
    o = observations(rows, key).withColumn("ok", F.when(F.col("is_error"), 0.0).otherwise(T.well_formed_turn(F.col("text"), F.col("tool_calls")).cast("double")))
    s = o.groupBy(key).agg(F.count("*").alias("turns"), F.avg("ok").alias("format"))
    return rows.select(key).distinct().join(s, key, "left").select(key, F.coalesce("turns", F.lit(0)).alias("turns"), F.coalesce("format", F.lit(0.0)).alias("format"))


def step_summary(rows: DataFrame, key: str = "traj_id", most: int = 20) -> DataFrame:
    """(key, steps, summary): up to most numbered steps, the first call of each turn with arguments cut at 300 and the result at 400 characters."""
    w = Window.partitionBy(key).orderBy("turn")
    o = observations(rows, key).where("coalesce(size(tool_calls), 0) > 0")
    o = o.withColumn("no", F.row_number().over(w)).where(F.col("no") <= most)
    first = F.element_at("tool_calls", 1)
    result = F.when(F.col("next_role") == "tool", F.left("next_text", F.lit(400))).otherwise("")
    line = F.concat(F.lit("Step "), F.col("no").cast("string"), F.lit(": "), F.coalesce(first["function"]["name"], F.lit("unknown")), F.lit("("), F.left(F.coalesce(first["function"]["arguments"], F.lit("{}")), F.lit(300)), F.lit(")\n  Result: "), F.coalesce(result, F.lit("")))
    lines = F.sort_array(F.collect_list(F.struct("no", line.alias("line"))))
    return o.groupBy(key).agg(F.count("*").alias("steps"), F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("summary"))


def last_messages(rows: DataFrame, key: str = "traj_id") -> DataFrame:
    """(key, role, text) of each conversation's last message."""
    m = F.element_at("messages", -1)
    return rows.where("size(messages) > 0").select(key, m["role"].alias("role"), T.parts_text(m["content"]).alias("text"))


def first_violation(messages: Column, tools: Column | None = None, images: Column | None = None) -> Column:
    """The first breach of the contract of a training row, null if there is none.

    In this order of rules: messages; per message its role, content, calls outside assistant turns, and per call its id,
    tool and arguments; results against pending calls and their names; calls left over; a final answer; image parts
    against images. A fold over the messages with the pending calls as its state. The messages' wording is fixed.
    """
    pending_type = "array<struct<id:string,name:string>>"
    start = F.struct(
        F.lit(0).alias("at"),
        F.lit(None).cast("string").alias("error"),
        F.array().cast(pending_type).alias("pending"),
        F.lit(False).alias("final"),
    )

    def call_error(at: Column, c: Column, i: Column, pending: Column, before: Column) -> Column:
        where = F.concat(F.lit("messages["), at.cast("string"), F.lit("]"))
        twice = F.exists(pending, lambda p: p["id"] == c["id"]) | F.exists(before, lambda b: b["id"] == c["id"])
        bad_id = F.coalesce(c["id"], F.lit("")) == ""
        out = F.when(F.coalesce(bad_id | twice, F.lit(True)), F.concat(where, F.lit(".tool_calls["), i.cast("string"), F.lit("] has an invalid id")))
        if tools is not None:
            out = out.when(~F.coalesce(F.array_contains(tools, c["function"]["name"]), F.lit(False)), F.concat(where, F.lit(" calls undefined tool")))
        return out.when(c["function"]["arguments"].isNull(), F.concat(where, F.lit(".tool_calls["), i.cast("string"), F.lit("] has invalid arguments")))

    def step(s: Column, m: Column) -> Column:
        at, pending = s["at"], s["pending"]
        where = F.concat(F.lit("messages["), at.cast("string"), F.lit("]"))
        cs = F.coalesce(m["tool_calls"], F.array().cast("array<struct<type:string,id:string,function:struct<name:string,arguments:string>>>"))
        bad_part = F.exists(m["content"], lambda p: F.coalesce(~p["type"].isin("text", "image"), F.lit(True)) | ((p["type"] == "text") & p["text"].isNull()))
        errors = F.filter(F.transform(cs, lambda c, i: call_error(at, c, i, pending, F.slice(cs, F.lit(1), i))), lambda e: e.isNotNull())
        hit = F.filter(pending, lambda p: p["id"] == m["tool_call_id"])
        result = m["role"] == "tool"
        error = (
            F.when(s["error"].isNotNull(), s["error"])
            .when(F.coalesce(~m["role"].isin(*ROLES), F.lit(True)), F.concat(where, F.lit(".role is invalid")))
            .when(m["content"].isNull(), F.concat(where, F.lit(".content must be a content-part list")))
            .when(bad_part, F.concat(where, F.lit(".content has an invalid part")))
            .when((F.size(cs) > 0) & (m["role"] != "assistant"), F.concat(where, F.lit(" has tool_calls outside an assistant turn")))
            .when(F.size(errors) > 0, F.element_at(errors, 1))
            .when(result & (F.size(hit) == 0), F.concat(where, F.lit(" has no matching pending tool call")))
            .when(result & ~F.coalesce(F.element_at(hit, 1)["name"] == m["name"], F.lit(False)), F.concat(where, F.lit(" tool name does not match")))
        )
        after = F.when(result, F.filter(pending, lambda p: p["id"] != m["tool_call_id"])).otherwise(F.concat(pending, F.transform(cs, lambda c: F.struct(c["id"].alias("id"), c["function"]["name"].alias("name")))))
        says = (m["role"] == "assistant") & (F.size(cs) == 0) & F.exists(m["content"], lambda p: (p["type"] == "text") & (T.strip(p["text"]) != ""))
        return F.struct((at + 1).alias("at"), error.alias("error"), after.alias("pending"), (s["final"] | F.coalesce(says, F.lit(False))).alias("final"))

    end = F.aggregate(messages, start, step)
    out = F.when(messages.isNull() | (F.size(messages) == 0), "messages must be a non-empty list").when(end["error"].isNotNull(), end["error"])
    out = out.when(F.size(end["pending"]) > 0, "trajectory ends with unmatched tool calls").when(~end["final"], "trajectory has no final assistant answer")
    if images is not None:
        n = placeholders(messages)
        out = out.when(n != F.coalesce(F.size(images), F.lit(0)), F.concat(F.lit("image placeholder count "), n.cast("string"), F.lit(" does not match images count "), F.coalesce(F.size(images), F.lit(0)).cast("string")))
    return out


def placeholders(messages: Column) -> Column:
    """Image parts in all messages."""
    return F.aggregate(messages, F.lit(0), lambda n, m: n + F.coalesce(F.size(F.filter(m["content"], lambda p: p["type"] == "image")), F.lit(0)))


def convert_sft(turn_rows: DataFrame, key: str = "row_id", strict: bool = True) -> DataFrame:
    """(key, messages, error) from raw turns (key, turn, from, value): roles in chat form, image marks as parts, the call of an assistant turn taken out of its text, and each result paired with the last open call.

    error: a result without a call, or an end with one open; strict also reports a call that overwrites an open one and
    unknown roles, which otherwise pass or are left out.
    """
    call = T.tool_call_text(F.col("value"))
    ok = F.get_json_object(F.coalesce(F.get_json_object(call, "$.function"), call), "$.name")
    fn = F.coalesce(F.get_json_object(call, "$.function"), call)
    kind = F.when(F.col("from") == "human", "user").when(F.col("from") == "gpt", "assistant").when(F.col("from").isin("observation", "tool"), "tool")
    closed = r"(?s)<tool_call>\s*\{.*?\}\s*</tool_call>"
    has = F.col("value").rlike(closed) & ok.isNotNull()
    one = F.regexp_extract(F.col("value"), closed, 0)
    clean = F.when(has, T.strip(F.concat(F.element_at(F.split("value", "<tool_call>", 2), 1), F.substring(F.col("value"), F.instr(F.col("value"), one) + F.length(one), F.length("value"))))).otherwise(F.col("value"))
    t = turn_rows.select(key, "turn", kind.alias("role"), F.coalesce("value", F.lit("")).alias("value"), F.col("from").alias("raw_role"))
    t = t.withColumn("call_name", F.when((F.col("role") == "assistant") & has, ok)).withColumn("arguments", F.when(F.col("call_name").isNotNull(), F.coalesce(F.get_json_object(fn, "$.arguments"), F.lit("{}"))))
    t = t.withColumn("value", F.when(F.col("role") == "assistant", clean).otherwise(F.col("value")))
    w = Window.partitionBy(key).orderBy("turn")
    # the pending call before a turn: the last call, unless a result came after it
    last = lambda c: F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    t = t.withColumn("last_call", last(F.when(F.col("call_name").isNotNull(), F.struct("turn", "call_name")))).withColumn("last_result", last(F.when(F.col("role") == "tool", F.col("turn"))))
    open_ = F.col("last_call").isNotNull() & (F.coalesce("last_result", F.lit(-1)) < F.col("last_call.turn"))
    t = t.withColumn("open", F.coalesce(open_, F.lit(False)))
    err = F.when((F.col("role") == "tool") & ~F.col("open"), "tool result has no preceding tool call")
    if strict:
        err = err.when(F.col("call_name").isNotNull() & F.col("open"), "a call overwrites an open one").when(F.col("role").isNull(), "unknown role")
    cid = lambda n: F.concat(F.lit("call-"), n.cast("string"))
    none = F.lit(None)
    text = F.array(F.struct(F.lit("text").alias("type"), F.col("value").alias("text")))
    content = F.when(F.col("role") == "user", T.image_parts(F.col("value"))).when((F.col("role") == "assistant") & (F.col("value") == ""), F.array().cast("array<struct<type:string,text:string>>")).otherwise(text)
    calls_ = F.when(F.col("call_name").isNotNull(), F.array(F.struct(F.lit("function").alias("type"), cid(F.col("turn")).alias("id"), F.struct(F.col("call_name").alias("name"), F.col("arguments").alias("arguments")).alias("function"))))
    m = F.struct("turn", F.struct("role", content.alias("content"), calls_.alias("tool_calls"), F.when(F.col("role") == "tool", cid(F.col("last_call.turn"))).otherwise(none).alias("tool_call_id"), F.when(F.col("role") == "tool", F.col("last_call.call_name")).otherwise(none).alias("name")).alias("m"))
    g = t.withColumn("error", err).groupBy(key).agg(
        F.min(F.when(F.col("error").isNotNull(), F.struct("turn", "error")))["error"].alias("error"),
        F.sort_array(F.collect_list(F.when(F.col("role").isNotNull(), m))).alias("ms"),
        F.max(F.when(F.col("call_name").isNotNull(), F.col("turn"))).alias("c"),
        F.max(F.when(F.col("role") == "tool", F.col("turn"))).alias("r"),
    )
    left = F.coalesce(F.col("c") > F.coalesce(F.col("r"), F.lit(-1)), F.lit(False))
    return g.select(key, F.transform("ms", lambda x: x["m"]).alias("messages"), F.coalesce("error", F.when(left, "trajectory ends before its tool result")).alias("error"))


def convert_rl(rows: DataFrame, system: str, images: str = "images", question: str = "question", answer: str = "answer", dataset: str = "dataset") -> DataFrame:
    """(prompt, answer, images, dataset): a system message, and a user message of one image part for each image before the question."""
    none = F.lit(None).cast("string")
    image = F.transform(F.coalesce(images, F.array().cast("array<string>")), lambda _: F.struct(F.lit("image").alias("type"), none.alias("text")))
    user = F.concat(image, F.array(F.struct(F.lit("text").alias("type"), F.col(question).alias("text"))))
    sys = F.array(F.struct(F.lit("text").alias("type"), F.lit(system).alias("text")))
    prompt = F.array(F.struct(F.lit("system").alias("role"), sys.alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))
    return rows.select(prompt.alias("prompt"), F.col(answer).alias("answer"), F.coalesce(images, F.array().cast("array<string>")).alias("images"), F.coalesce(dataset, F.lit("unknown")).alias("dataset"))


def normalise_prompt(messages: Column, system: str) -> Column:
    """The prompt with a system message in front, if it has none there."""
    sys = F.struct(F.lit("system").alias("role"), F.array(F.struct(F.lit("text").alias("type"), F.lit(system).alias("text"))).alias("content"))
    return F.when(F.element_at(messages, 1)["role"] == "system", messages).otherwise(F.concat(F.array(sys), messages))
