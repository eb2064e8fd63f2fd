"""Registered queries of the core and their SQL. Each runs over its whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import records as D
from ..functions import text as T
from ..operators import agentlog as A
from ..operators import conversation as C
from ..operators import gates as G
from ..operators import graph as N
from ..operators import images as I
from ..operators import retrieval as R
from ..operators import rewards as W
from ..operators import similarity as S
from ..operators import statistics as P
from ..operators import temporal as X
from ..operators import validation as V
from ..session import shared_dir
from ..sources.tables import table
from ..streaming import agent_stream as E

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL if SQL can say it."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


# SQL that several queries share: turns of trajectories with their texts, in DuckDB
_TURNS = """t AS (
  SELECT traj_id, unnest(generate_series(0, len(messages) - 1)) AS turn, unnest(messages) AS m FROM trajectories
), turns AS (
  SELECT traj_id, turn, m.role AS role, m.tool_calls AS tool_calls, m.tool_call_id AS tool_call_id, m.name AS name, m.content AS content,
         coalesce(array_to_string(list_transform(list_filter(m.content, lambda p: p.type = 'text' AND p.text IS NOT NULL), lambda p: p.text), chr(10)), '') AS text
  FROM t
)"""
_MARKERS = " OR ".join(f"contains(replace(lower(next_text), 'ß', 'ss'), '{m}')" for m in T.ERROR_MARKERS)
_OBS = f"""{_TURNS}, led AS (
  SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM turns WINDOW w AS (PARTITION BY traj_id ORDER BY turn)
), obs AS (
  SELECT *, coalesce(next_role = 'tool' AND ({_MARKERS}), false) AS is_error FROM led WHERE role = 'assistant'
)"""
_SPACE = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _sq(c: str) -> str:
    return rf"trim(regexp_replace({c}, '{_SPACE}+', ' ', 'g'))"


def _norm(c: str) -> str:
    inner = rf"regexp_replace(replace(lower({c}), 'ß', 'ss'), '[^\p{{L}}\p{{M}}\p{{N}}_\s]', ' ', 'g')"
    return _sq(inner)


def _strip(c: str) -> str:
    return rf"regexp_replace(coalesce({c}, ''), '^{_SPACE}+|{_SPACE}+$', '', 'g')"


# ---------------------------------------------------------------- conversations


@query("""
    SELECT coalesce(split, 'none') AS split, coalesce(messages[-1].role, 'none') AS last_role,
           count(*) AS trajectories, cast(sum(len(list_filter(messages, lambda m: m.role = 'assistant'))) AS bigint) AS assistant_turns
    FROM trajectories GROUP BY 1, 2""")
def trajectory_audit(spark: SparkSession, d: str) -> DataFrame:
    """Trajectories by split and role of the last message, with their assistant turns."""
    return (
        table(spark, d, "trajectories")
        .select(
            F.coalesce("split", F.lit("none")).alias("split"),
            F.coalesce(F.expr("element_at(messages, -1).role"), F.lit("none")).alias("last_role"),
            F.expr("cast(size(filter(messages, m -> m.role = 'assistant')) as bigint)").alias("turns"),
        )
        .groupBy("split", "last_role")
        .agg(F.count("*").alias("trajectories"), F.sum("turns").alias("assistant_turns"))
    )


@query(f"""WITH {_TURNS}, c AS (
      SELECT traj_id, turn, x.id AS call_id FROM (SELECT traj_id, turn, unnest(tool_calls) AS x FROM turns)
    ), r AS (SELECT traj_id, turn, tool_call_id AS call_id FROM turns WHERE role = 'tool')
    SELECT traj_id, turn, 'call' AS kind FROM c WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.traj_id = c.traj_id AND r.call_id = c.call_id AND r.turn > c.turn)
    UNION ALL
    SELECT traj_id, turn, 'result' FROM r WHERE NOT EXISTS (SELECT 1 FROM c WHERE r.traj_id = c.traj_id AND r.call_id = c.call_id AND r.turn > c.turn)""")
def turn_pairing_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Calls without a result, and results without a call."""
    return C.unmatched(table(spark, d, "trajectories"))


@query(f"WITH {_OBS} SELECT traj_id, turn, next_role, cast(length(next_text) AS bigint) AS next_chars, is_error FROM obs")
def observation_lead(spark: SparkSession, d: str) -> DataFrame:
    """The message right after each assistant turn."""
    o = C.observations(table(spark, d, "trajectories"))
    return o.select("traj_id", "turn", "next_role", F.length("next_text").cast("bigint").alias("next_chars"), "is_error")


@query("""WITH e AS (
      SELECT user_id, row_number() OVER w AS pos, event_type = 'error' AS err,
             sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, min(pos) AS first, count(*) AS length FROM e WHERE err GROUP BY user_id, island HAVING count(*) >= 3""")
def consecutive_error_islands(spark: SparkSession, d: str) -> DataFrame:
    """Runs of three or more errors of a user."""
    e = table(spark, d, "events").withColumn("err", F.col("event_type") == "error")
    return C.error_runs(e, "user_id", ["ts", "event_id"], "err")


@query(f"""WITH {_OBS}, isl AS (
      SELECT *, sum(CASE WHEN is_error THEN 0 ELSE 1 END) OVER (PARTITION BY traj_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS island FROM obs
    ), cut AS (SELECT traj_id, min(c) AS cut FROM (SELECT traj_id, min(turn) AS c FROM isl WHERE is_error GROUP BY traj_id, island HAVING count(*) >= 3) GROUP BY traj_id
    ), ans AS (
      SELECT traj_id, arg_max({_strip("regexp_extract(text, '(?is)<response>(.*?)</response>', 1)")}, turn) AS a FROM turns
      WHERE role = 'assistant' AND coalesce(len(tool_calls), 0) = 0 AND regexp_matches(text, '(?is)<response>.*?</response>') GROUP BY traj_id)
    SELECT traj_id, cut, cut IS NOT NULL OR coalesce(a, '') = '' AS fatal FROM (SELECT DISTINCT traj_id FROM trajectories) LEFT JOIN cut USING (traj_id) LEFT JOIN ans USING (traj_id)""")
def fatal_prefix_cut(spark: SparkSession, d: str) -> DataFrame:
    """Where each trajectory is cut, and whether it is fatal."""
    return C.fatal_cut(table(spark, d, "trajectories"))


@query(f"""WITH {_TURNS} SELECT traj_id, arg_max({_strip("regexp_extract(text, '(?is)<response>(.*?)</response>', 1)")}, turn) AS answer FROM turns
    WHERE role = 'assistant' AND coalesce(len(tool_calls), 0) = 0 AND regexp_matches(text, '(?is)<response>.*?</response>') GROUP BY traj_id""")
def trajectory_final_answer(spark: SparkSession, d: str) -> DataFrame:
    """The final answer of each trajectory that has one."""
    return C.final_answers(table(spark, d, "trajectories"))


@query("""WITH l AS (SELECT namespace, cache_key, arg_max(value, struct_pack(a := updated_at, b := cache_id)) AS v FROM tool_cache WHERE updated_at IS NOT NULL AND namespace IS NOT NULL AND cache_key IS NOT NULL AND value IS NOT NULL GROUP BY ALL)
    SELECT t.cache_id, l.v IS NOT NULL AS hit, cast(length(coalesce(l.v, t.cache_key, '')) AS bigint) AS chars FROM tool_cache t LEFT JOIN l ON l.namespace = 'page' AND l.cache_key = t.cache_key""")
def cache_lookup_fill(spark: SparkSession, d: str) -> DataFrame:
    """Every key looked up among the read pages, and filled with itself where there is none."""
    t = table(spark, d, "tool_cache")
    stored = t.where("updated_at is not null and namespace is not null and cache_key is not null and value is not null").select("namespace", "cache_key", "value", "updated_at", "cache_id")
    pages = R.latest(stored, ["namespace", "cache_key"], tie="cache_id")
    asked = t.select("cache_id", F.lit("page").alias("namespace"), "cache_key")
    r = R.lookup(asked, pages, ["namespace", "cache_key"], "value", F.coalesce("cache_key", F.lit("")))
    return r.select("cache_id", "hit", F.length("value").cast("bigint").alias("chars"))


_ROWS = """r AS (SELECT row_id, turn, role, coalesce(array_to_string(list_transform(list_filter(content, lambda p: p.type = 'text' AND p.text IS NOT NULL), lambda p: p.text), chr(10)), '') AS text,
      loaded_at, message_id FROM sft_messages
    ), l AS (SELECT row_id, turn, arg_max(struct_pack(role := role, text := text), struct_pack(loaded_at := loaded_at, message_id := message_id)) AS m FROM r GROUP BY row_id, turn
    ), s AS (SELECT row_id, turn, m.role AS role, m.text AS text FROM l)"""


def _sft_turns(spark: SparkSession, d: str) -> DataFrame:
    """(row_id, turn, role, text) of SFT rows: of a message delivered again the last load stays."""
    m = table(spark, d, "sft_messages").select("row_id", "turn", F.struct("loaded_at", "message_id").alias("o"), F.struct("role", T.parts_text(F.col("content")).alias("text")).alias("m"))
    return m.groupBy("row_id", "turn").agg(F.max_by("m", "o").alias("m")).select("row_id", "turn", "m.*")


_FORMAT_SQL = r"(?s)^<think>.*?</think>\s*(?:<tool_call>.*?</tool_call>|<response>.*?</response>)\s*$"


@query(f"""WITH {_ROWS} SELECT row_id, count(*) AS turns, avg(CASE WHEN regexp_matches({_strip('text')}, '{_FORMAT_SQL}') THEN 1.0 ELSE 0.0 END) AS format
    FROM s WHERE role = 'assistant' GROUP BY row_id""")
def format_mean(spark: SparkSession, d: str) -> DataFrame:
    """The share of well-formed assistant turns of each SFT row."""
    s = _sft_turns(spark, d).where("role = 'assistant'").withColumn("ok", T.well_formed_turn(F.col("text")).cast("double"))
    return s.groupBy("row_id").agg(F.count("*").alias("turns"), F.avg("ok").alias("format"))


@query(f"""WITH {_ROWS} SELECT row_id, arg_max({_strip("regexp_extract(text, '(?is)<response>(.*?)</response>', 1)")}, turn) AS answer
    FROM s WHERE role = 'assistant' AND regexp_matches(text, '(?is)<response>.*?</response>') GROUP BY row_id""")
def final_answer_per_conversation(spark: SparkSession, d: str) -> DataFrame:
    """The last response block of each SFT row."""
    s = _sft_turns(spark, d).where("role = 'assistant'").withColumn("answer", T.response_block(F.col("text"))).where("answer is not null")
    return s.groupBy("row_id").agg(F.max_by("answer", "turn").alias("answer"))


@query(f"""WITH {_OBS}, n AS (SELECT *, row_number() OVER (PARTITION BY traj_id ORDER BY turn) AS no FROM obs WHERE len(tool_calls) > 0)
    SELECT traj_id, count(*) AS steps, string_agg('Step ' || no || ': ' || coalesce(tool_calls[1].function.name, 'unknown') || '(' || left(coalesce(tool_calls[1].function.arguments, '{{}}'), 300)
      || ')' || chr(10) || '  Result: ' || CASE WHEN next_role = 'tool' THEN left(next_text, 400) ELSE '' END, chr(10) ORDER BY no) AS summary
    FROM n WHERE no <= 20 GROUP BY traj_id""")
def step_numbering_top20(spark: SparkSession, d: str) -> DataFrame:
    """The numbered steps of each trajectory."""
    return C.step_summary(table(spark, d, "trajectories"))


@query("""SELECT user_id, count(*) AS lines, string_agg('TOOL_RESULT ' || event_type || ': ' || left(props, 3000), chr(10) ORDER BY ts, event_id) AS trace
    FROM events WHERE event_type IN ('click', 'error') GROUP BY user_id""")
def trace_text(spark: SparkSession, d: str) -> DataFrame:
    """The events of a user as labelled lines."""
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type").isin("click", "error"), "tool_finished")
    return A.trace(e, "user_id", ["ts", "event_id"], A.event_line(kind, F.lit(None), F.col("event_type"), F.lit(None), F.col("props")))


@query("""WITH p AS (SELECT message_id, unnest(generate_series(0, len(content) - 1)) AS part, unnest(content) AS c FROM sft_messages
    ), q AS (SELECT message_id, part, string_split(coalesce(c.text, ''), '<image>') AS x FROM p WHERE c.type = 'text'
    ), e AS (SELECT message_id, part, unnest(generate_series(0, len(x) - 1)) AS i, unnest(x) AS s, len(x) AS n FROM q)
    SELECT message_id, part, 'image' AS kind, cast(count(*) AS bigint) AS parts, cast(0 AS bigint) AS chars FROM e WHERE i > 0 GROUP BY ALL
    UNION ALL
    SELECT message_id, part, 'text', cast(count(*) AS bigint), cast(sum(length(s)) AS bigint) FROM e WHERE s <> '' OR n = 1 GROUP BY message_id, part""")
def content_parts_explode(spark: SparkSession, d: str) -> DataFrame:
    """Parts of each text part around its image marks."""
    p = table(spark, d, "sft_messages").select("message_id", F.posexplode("content").alias("part", "c")).where("c.type = 'text'")
    e = p.select("message_id", F.col("part").cast("bigint").alias("part"), F.explode(T.image_parts(F.col("c.text"))).alias("x"))
    return e.groupBy("message_id", "part", F.col("x.type").alias("kind")).agg(F.count("*").alias("parts"), F.coalesce(F.sum(F.length("x.text")), F.lit(0)).cast("bigint").alias("chars"))


@query("""SELECT split, count(*) AS records, cast(sum(len(list_filter(messages, lambda m: len(coalesce(m.tool_calls, [])) > 0))) AS bigint) AS call_turns,
      cast(sum(coalesce(list_sum(list_transform(messages, lambda m: len(list_filter(m.content, lambda p: p.type = 'image')))), 0)) AS bigint) AS images
    FROM trajectories GROUP BY split""")
def dataset_report(spark: SparkSession, d: str) -> DataFrame:
    """Records, turns with calls and images of each split."""
    t = table(spark, d, "trajectories")
    calls = F.size(F.filter("messages", lambda m: F.coalesce(F.size(m["tool_calls"]), F.lit(0)) > 0))
    return t.groupBy("split").agg(F.count("*").alias("records"), F.sum(calls.cast("bigint")).alias("call_turns"), F.sum(C.placeholders(F.col("messages")).cast("bigint")).alias("images"))


_DECLARED = ["text_search", "image_search", "web_search", "visit"]


@query(f"""WITH {_TURNS}, c AS (SELECT traj_id, turn, x.function.name AS name FROM (SELECT traj_id, turn, unnest(tool_calls) AS x FROM turns)
    ), u AS (SELECT traj_id, min(turn) AS turn FROM c WHERE name NOT IN ('text_search', 'image_search', 'web_search', 'visit') GROUP BY traj_id
    ), n AS (SELECT traj_id, cast(sum(coalesce(len(list_filter(content, lambda p: p.type = 'image')), 0)) AS bigint) AS images FROM turns GROUP BY traj_id)
    SELECT n.traj_id, coalesce('messages[' || u.turn || '] calls undefined tool', 'image placeholder count ' || images || ' does not match images count 1') AS error FROM n LEFT JOIN u USING (traj_id) WHERE u.turn IS NOT NULL OR images <> 1""")
def violations_first_error(spark: SparkSession, d: str) -> DataFrame:
    """The first breach of the training contract of each trajectory that has one, against four declared tools and one image. The SQL knows the two rules that these tables break; all rules are tested on their own."""
    t = table(spark, d, "trajectories")
    tools, images = F.array(*[F.lit(x) for x in _DECLARED]), F.array(F.lit("file:///input.png"))
    return t.select("traj_id", C.first_violation(F.col("messages"), tools, images).alias("error")).where("error is not null")


@query(f"""WITH x AS (SELECT traj_id, list_filter(messages, lambda m: m.role = 'user') AS p, final_answer AS a FROM trajectories
    ), y AS (SELECT traj_id, p, a, coalesce(list_sum(list_transform(p, lambda m: coalesce(len(list_filter(m.content, lambda c: c.type = 'image')), 0))), 0) AS n FROM x)
    SELECT traj_id, CASE WHEN coalesce(len(p), 0) = 0 THEN 'prompt must be a non-empty message list' WHEN {_strip('a')} = '' THEN 'answer must contain at least one non-empty string'
      WHEN n <> 1 THEN 'image placeholder count ' || cast(n AS bigint) || ' does not match images count 1' END AS error,
      cast(CASE WHEN {_sq('a')} = '' OR a IS NULL THEN 0 ELSE len(string_split({_sq('a')}, ' ')) END AS bigint) AS answer_words FROM y""")
def rl_row_validation(spark: SparkSession, d: str) -> DataFrame:
    """Trajectories as rows for reinforcement learning: what is wrong with each, and the words of its answer."""
    t = table(spark, d, "trajectories").select("traj_id", F.filter("messages", lambda m: m["role"] == "user").alias("prompt"), F.array("final_answer").alias("answers"))
    return t.select("traj_id", V.rl_error(F.col("prompt"), F.array(F.lit("file:///input.png")), F.col("answers")).alias("error"), V.answer_words(F.col("answers")).alias("answer_words"))


@query(f"""WITH {_ROWS} SELECT row_id, cast(sum(CASE WHEN text LIKE '%<image>%' THEN len(string_split(text, '<image>')) - 1 ELSE 0 END) AS bigint) AS marks,
      count(*) FILTER (role = 'user') AS questions FROM s GROUP BY row_id""")
def placeholder_count(spark: SparkSession, d: str) -> DataFrame:
    """Image marks in the texts of each SFT row, and its user turns."""
    marks = F.size(F.split("text", "<image>")) - 1
    return _sft_turns(spark, d).groupBy("row_id").agg(F.sum(marks.cast("bigint")).alias("marks"), F.count_if(F.col("role") == "user").alias("questions"))


@query(f"""WITH {_ROWS}, x AS (SELECT row_id, turn, role, role = 'assistant' AND regexp_matches(text, '(?s)<tool_call>\\s*\\{{.*?\\}}\\s*</tool_call>') AND
        json_extract_string(try_cast(regexp_extract(text, '(?s)<tool_call>\\s*(\\{{.*?\\}})\\s*</tool_call>', 1) AS json), '$.name') IS NOT NULL AS call FROM s WHERE role <> 'system'
    ), w AS (SELECT *, max(CASE WHEN call THEN turn END) OVER p AS last_call, max(CASE WHEN role = 'tool' THEN turn END) OVER p AS last_result FROM x WINDOW p AS (PARTITION BY row_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    ), e AS (SELECT *, CASE WHEN role = 'tool' AND NOT coalesce(last_call > coalesce(last_result, -1), false) THEN 'tool result has no preceding tool call' WHEN call AND coalesce(last_call > coalesce(last_result, -1), false) THEN 'a call overwrites an open one'
        WHEN role NOT IN ('user', 'assistant', 'tool') THEN 'unknown role' END AS err FROM w)
    SELECT row_id, count(*) FILTER (role IN ('user', 'assistant', 'tool')) AS messages, count(*) FILTER (call) AS calls,
      coalesce(arg_min(err, turn) FILTER (err IS NOT NULL), CASE WHEN coalesce(max(turn) FILTER (call) > coalesce(max(turn) FILTER (role = 'tool'), -1), false) THEN 'trajectory ends before its tool result' END) AS error FROM e GROUP BY row_id""")
def sft_conversion(spark: SparkSession, d: str) -> DataFrame:
    """SFT rows in chat form with calls and results paired, and what is wrong with them."""
    raw = F.create_map(*[F.lit(x) for x in ("user", "human", "assistant", "gpt", "tool", "observation")])
    s = _sft_turns(spark, d).where("role <> 'system'").select("row_id", "turn", F.element_at(raw, F.col("role")).alias("from"), F.col("text").alias("value"))
    c = C.convert_sft(s)
    return c.select("row_id", F.size("messages").cast("bigint").alias("messages"), F.size(F.filter("messages", lambda m: m["tool_calls"].isNotNull())).cast("bigint").alias("calls"), "error")


@query("""SELECT list_contains(['user'], messages[1].role) AS starts_with_user, count(*) AS n,
      cast(sum(len(messages) + CASE WHEN messages[1].role = 'system' THEN 0 ELSE 1 END) AS bigint) AS messages FROM trajectories WHERE len(messages) > 0 GROUP BY 1""")
def prompt_normalised(spark: SparkSession, d: str) -> DataFrame:
    """Prompts with a system message put in front where there is none."""
    t = table(spark, d, "trajectories").where("size(messages) > 0")
    p = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return t.groupBy((F.element_at("messages", 1)["role"] == "user").alias("starts_with_user")).agg(F.count("*").alias("n"), F.sum(F.size(C.normalise_prompt(p, "system")).cast("bigint")).alias("messages"))


# ---------------------------------------------------------------- gates

_QTEXT = """array_to_string(list_transform(list_filter(flatten(list_transform(list_filter(messages, lambda m: m.role = 'user'), lambda m: coalesce(m.content, []))), lambda p: p.type = 'text' AND p.text IS NOT NULL), lambda p: p.text), chr(10))"""


def _questions(t: DataFrame) -> DataFrame:
    return t.withColumn("question", T.parts_text(F.flatten(F.transform(F.filter("messages", lambda m: (m["role"] == "user") & m["content"].isNotNull()), lambda m: m["content"]))))


@query(f"""WITH q AS (SELECT traj_id, {_norm(f"coalesce({_QTEXT}, '')")} AS q FROM trajectories), n AS (SELECT DISTINCT title AS name, {_norm('title')} AS norm FROM hub_pages WHERE title IS NOT NULL)
    , w AS (SELECT doc_id, {_norm('text')} AS q FROM documents)
    SELECT doc_id AS id, 'document' AS kind, name FROM w, n WHERE norm <> '' AND contains(q, norm)
    UNION ALL SELECT traj_id, 'question', name FROM q, n WHERE norm <> '' AND contains(q, norm)""")
def leak_check_join(spark: SparkSession, d: str) -> DataFrame:
    """Documents and questions that contain the name of a hub page."""
    names = table(spark, d, "hub_pages").where("title is not null").select("title")
    docs = G.leaks(table(spark, d, "documents"), "doc_id", "text", names, "title").select(F.col("doc_id").alias("id"), F.lit("document").alias("kind"), "name")
    qs = G.leaks(_questions(table(spark, d, "trajectories")), "traj_id", "question", names, "title").select(F.col("traj_id").alias("id"), F.lit("question").alias("kind"), "name")
    return docs.unionByName(qs)


@query("""WITH a AS (SELECT dataset, CASE WHEN process.accepted IS NOT TRUE THEN 'accepted' WHEN process.no_redundant_search IS NOT TRUE THEN 'redundant' WHEN coalesce(process.score, 0) < 0.6 THEN 'score' END AS stage FROM trajectories)
    SELECT dataset, CASE WHEN stage IS NULL THEN 'accepted' ELSE 'rejected' END AS status, stage, count(*) AS n FROM a GROUP BY ALL""")
def strict_gate_audit(spark: SparkSession, d: str) -> DataFrame:
    """Trajectories by the first check that refuses them; a missing verdict refuses."""
    t = table(spark, d, "trajectories")
    p = F.col("process")
    a = G.audit(t, [("accepted", p["accepted"]), ("redundant", p["no_redundant_search"]), ("score", F.coalesce(p["score"], F.lit(0.0)) >= 0.6)])
    return a.groupBy("dataset", "status", "stage").agg(F.count("*").alias("n"))


@query(f"""WITH a AS (SELECT traj_id, {_norm(f"coalesce({_QTEXT}, '')")} AS q, {_norm('final_answer')} AS a, process.accepted IS TRUE AS ok, process.no_redundant_search IS TRUE AS direct, coalesce(process.score, 0) >= 0.6 AS good FROM trajectories)
    SELECT traj_id, ok AND direct AND good AND NOT (coalesce(a, '') <> '' AND contains(q, a)) AS accepted FROM a""")
def quality_gate(spark: SparkSession, d: str) -> DataFrame:
    """The strict gate of eight verdicts with the process verdicts as the judge's; whether the answer leaks into the question is told by the texts."""
    p = F.col("process")
    said = {k: p["accepted"] for k in G.VERDICTS} | {"unique_entity_path": p["no_redundant_search"], "nontrivial": F.coalesce(p["score"], F.lit(0.0)) >= 0.6}
    return _questions(table(spark, d, "trajectories")).select("traj_id", G.quality(F.col("question"), F.lit(None).cast("array<string>"), F.col("final_answer"), said).alias("accepted"))


@query(f"""WITH a AS (SELECT traj_id, coalesce({_QTEXT}, '') AS q, final_answer AS a FROM trajectories)
    SELECT traj_id, CASE WHEN {_strip('q')} = '' OR {_strip('a')} = '' THEN 'empty question or answer'
      WHEN len(string_split({_sq('a')}, ' ')) > 6 THEN 'answer exceeds six tokens'
      WHEN regexp_replace(replace(lower(a), 'ß', 'ss'), '^[ .]+|[ .]+$', '', 'g') IN ('valid name', 'one year', 'unknown', 'not known', 'none', 'various') THEN 'answer is generic'
      WHEN NOT contains(lower(q), 'image') THEN 'source anchor is not visual' END AS reason FROM a""")
def answer_gate_reason(spark: SparkSession, d: str) -> DataFrame:
    """Why each question and answer would be refused."""
    return _questions(table(spark, d, "trajectories")).select("traj_id", G.answer_reason(F.col("question"), F.col("final_answer")).alias("reason"))


@query("""SELECT sample_index, min(traj_id) AS traj_id FROM trajectories WHERE process.accepted GROUP BY sample_index""")
def first_accepted_attempt(spark: SparkSession, d: str) -> DataFrame:
    """The first accepted trajectory of each sample."""
    t = table(spark, d, "trajectories").select("sample_index", "traj_id", F.col("process.accepted").alias("accepted"))
    return G.first_accepted(t, "sample_index", ["traj_id"], "accepted").select("sample_index", "traj_id")


@query("""SELECT traj_id, cast(count(CASE WHEN process.accepted IS NOT TRUE THEN final_answer END) OVER (PARTITION BY sample_index ORDER BY traj_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bigint) AS avoided,
      coalesce(string_agg(CASE WHEN process.accepted IS NOT TRUE THEN final_answer END, '|') OVER (PARTITION BY sample_index ORDER BY traj_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS avoid FROM trajectories""")
def avoid_list_prefix(spark: SparkSession, d: str) -> DataFrame:
    """The refused answers before each attempt of a sample."""
    t = table(spark, d, "trajectories").select("sample_index", "traj_id", "final_answer", F.col("process.accepted").alias("accepted"))
    a = G.avoid_lists(t, "sample_index", ["traj_id"], "final_answer", "accepted")
    return a.select("traj_id", F.size("avoid").cast("bigint").alias("avoided"), F.array_join("avoid", "|").alias("avoid"))


# ---------------------------------------------------------------- statistics

_WORDS = f"CASE WHEN {_sq('text')} = '' OR text IS NULL THEN 0 ELSE len(string_split({_sq('text')}, ' ')) END"


@query(f"""WITH w AS (SELECT source, cast({_WORDS} AS bigint) AS v FROM documents), s AS (SELECT source, list_sort(list(v)) AS l, count(*) AS n FROM w GROUP BY source)
    SELECT source, n, l[1] AS low, (l[(n - 1) // 2 + 1] + l[n // 2 + 1]) / 2.0 AS median, l[least(n - 1, cast(floor(n * 0.95) AS bigint)) + 1] AS p95, l[-1] AS high FROM s""")
def profile_p95(spark: SparkSession, d: str) -> DataFrame:
    """Words per text of each source: least, median, nearest-rank p95 and most."""
    w = table(spark, d, "documents").select("source", T.word_count(F.col("text")).alias("v"))
    return P.profile(w, "source", "v")


@query("""WITH h AS (SELECT doc_id, row_number() OVER (ORDER BY md5('3407:' || doc_id), doc_id) AS r, count(*) OVER () AS n FROM documents)
    SELECT doc_id, CASE WHEN r <= floor(n * 0.02) THEN 'validation' ELSE 'train' END AS split FROM h""")
def deterministic_split(spark: SparkSession, d: str) -> DataFrame:
    """int(n x 0.02) documents for validation, by seeded hash."""
    return P.split_rows(table(spark, d, "documents").select("doc_id"), "doc_id", 0.02)


_UNIT = "(('0x' || substr(md5('{}:' || {}), 1, 8))::bigint / 4294967296.0)"


@query(f"SELECT traj_id FROM trajectories WHERE {_UNIT.format('degrade', 'traj_id')} < 0.1")
def bernoulli_subset(spark: SparkSession, d: str) -> DataFrame:
    """A tenth of all trajectories, by hash."""
    return P.bernoulli(table(spark, d, "trajectories"), "traj_id", 0.1, "degrade").select("traj_id")


@query(f"""WITH u AS (SELECT {_UNIT.format('hops', 'c_custkey')} AS u FROM customer)
    SELECT CASE WHEN u < 0.4 THEN 2 WHEN u < 0.8 THEN 3 ELSE 4 END AS hops, count(*) AS n FROM u GROUP BY 1""")
def weighted_hops(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of hops by weight."""
    u = table(spark, d, "customer").select(P.hop_count(P.hash_unit(F.col("c_custkey"), "hops")).alias("hops"))
    return u.groupBy("hops").agg(F.count("*").alias("n"))


@query("SELECT text, source, min(doc_id) AS doc_id FROM documents GROUP BY text, source")
def dedup_ordered(spark: SparkSession, d: str) -> DataFrame:
    """The first document of each text and source."""
    return P.ordered_distinct(table(spark, d, "documents").select("doc_id", "text", "source"), ["text", "source"], ["doc_id"])


@query("SELECT kind, count(*) AS n FROM (SELECT 'document' AS kind FROM documents UNION ALL SELECT 'page' FROM page_nodes UNION ALL SELECT 'cache' FROM tool_cache) GROUP BY kind")
def union_sources(spark: SparkSession, d: str) -> DataFrame:
    """Rows of three sources put together."""
    u = None
    for kind, name in (("document", "documents"), ("page", "page_nodes"), ("cache", "tool_cache")):
        t = table(spark, d, name).select(F.lit(kind).alias("kind"))
        u = t if u is None else u.unionByName(t)
    return u.groupBy("kind").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT traj_id, sample_index, coalesce(process.score, 0) AS r, process.accepted IS NOT TRUE AS fatal FROM trajectories), g AS (SELECT *, avg(r) OVER w AS m, count(*) OVER w AS n FROM r WINDOW w AS (PARTITION BY sample_index))
    , a AS (SELECT *, (r - m) * CASE WHEN n > 1 THEN n / (n - 1) ELSE 1 END AS x FROM g)
    SELECT traj_id, round(CASE WHEN fatal THEN greatest(x, 0) ELSE x END, 6) AS advantage FROM a""")
def advantage_leave_one_out(spark: SparkSession, d: str) -> DataFrame:
    """Rewards against the mean of the others of their sample; not negative for fatal ones."""
    r = table(spark, d, "trajectories").where("sample_index is not null").select("traj_id", "sample_index", F.coalesce("process.score", F.lit(0.0)).alias("r"), (~F.coalesce("process.accepted", F.lit(False))).alias("fatal"))
    return P.leave_one_out(r, "sample_index", "r", "fatal").select("traj_id", F.round("advantage", 6).alias("advantage"))


# ---------------------------------------------------------------- rewards


_THINK = r"(?s)^<think>.*?</think>$"
_FORMAT_FULL = r"(?s)^<think>.*?</think>\s*(?:<tool_call>.*?</tool_call>|<response>.*?</response>)\s*$"
_REWARD = f"""WITH {_OBS}, isl AS (
      SELECT *, sum(CASE WHEN is_error THEN 0 ELSE 1 END) OVER (PARTITION BY traj_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS island FROM obs
    ), cut AS (SELECT traj_id, min(c) AS cut FROM (SELECT traj_id, min(turn) AS c FROM isl WHERE is_error GROUP BY traj_id, island HAVING count(*) >= 3) GROUP BY traj_id
    ), k AS (SELECT o.*, cut FROM obs o LEFT JOIN cut USING (traj_id)
    ), blocks AS (SELECT traj_id, turn, cut, {_strip("regexp_extract(text, '(?is)<response>(.*?)</response>', 1)")} AS a FROM k WHERE coalesce(len(tool_calls), 0) = 0 AND regexp_matches(text, '(?is)<response>.*?</response>')
    ), whole AS (SELECT traj_id, arg_max(a, turn) AS a FROM blocks GROUP BY traj_id
    ), fmt AS (SELECT traj_id, avg(CASE WHEN is_error THEN 0.0 WHEN regexp_matches({_strip('text')}, '{_FORMAT_FULL}') OR (coalesce(len(tool_calls), 0) = 1 AND regexp_matches({_strip('text')}, '{_THINK}')) THEN 1.0 ELSE 0.0 END) AS format,
        bool_or(coalesce(len(tool_calls), 0) > 0) AS acted FROM k WHERE cut IS NULL OR turn < cut GROUP BY traj_id
    ), j AS (SELECT t.traj_id, coalesce(format, 0.0) AS format, coalesce(acted, false) AS acted, cut IS NOT NULL OR coalesce(a, '') = '' AS fatal, a, final_answer, process FROM trajectories t LEFT JOIN cut USING (traj_id) LEFT JOIN whole USING (traj_id) LEFT JOIN fmt USING (traj_id)
    ), s AS (SELECT traj_id, format, fatal, CASE WHEN fatal THEN 0.0 WHEN final_answer IS NOT NULL AND replace(lower({_sq('final_answer')}), 'ß', 'ss') = replace(lower({_sq('a')}), 'ß', 'ss') THEN 1.0 WHEN process.accepted THEN 1.0 ELSE 0.0 END AS accuracy,
        CASE WHEN acted THEN greatest(0.0, least(1.0, coalesce(process.score, 0.0))) ELSE 0.0 END AS utility FROM j)"""


@query(f"{_REWARD} SELECT traj_id, round(format * (accuracy * 0.8 + utility * 0.2), 6) AS total, accuracy, round(utility, 6) AS utility, round(format, 6) AS format, CASE WHEN fatal THEN 1.0 ELSE 0.0 END AS fatal FROM s")
def reward_score(spark: SparkSession, d: str) -> DataFrame:
    """The five metrics of each trajectory, with the process verdicts as the judges'."""
    t = table(spark, d, "trajectories").select("traj_id", "messages", F.array("final_answer").alias("references"), "process")
    v = t.select("traj_id", F.coalesce("process.accepted", F.lit(False)).cast("double").alias("accuracy"), F.col("process.score").alias("utility"))
    r = W.scores(t.drop("process"), v)
    return r.select("traj_id", *[F.round(c, 6).alias(c) for c in ("total", "accuracy", "utility", "format", "fatal")])


@query(f"{_REWARD} SELECT round(avg(format * (accuracy * 0.8 + utility * 0.2)), 6) AS total, round(avg(accuracy), 6) AS accuracy, round(avg(utility), 6) AS utility, round(avg(format), 6) AS format, round(avg(CASE WHEN fatal THEN 1.0 ELSE 0.0 END), 6) AS fatal FROM s")
def reward_batch_means(spark: SparkSession, d: str) -> DataFrame:
    """The mean of each of the five metrics over all trajectories."""
    t = table(spark, d, "trajectories").select("traj_id", "messages", F.array("final_answer").alias("references"), "process")
    v = t.select("traj_id", F.coalesce("process.accepted", F.lit(False)).cast("double").alias("accuracy"), F.col("process.score").alias("utility"))
    m = W.batch_means(W.scores(t.drop("process"), v))
    return m.select(*[F.round(c, 6).alias(c) for c in ("total", "accuracy", "utility", "format", "fatal")])


@query("SELECT dataset, round(avg(coalesce(process.score, 0) * 0.2 + CASE WHEN process.accepted THEN 0.8 ELSE 0 END), 6) AS total, count(*) AS n FROM trajectories GROUP BY dataset")
def reward_means(spark: SparkSession, d: str) -> DataFrame:
    """The mean weighted verdict of each dataset."""
    t = table(spark, d, "trajectories")
    x = W.total(F.lit(1.0), F.coalesce("process.accepted", F.lit(False)).cast("double"), F.col("process.score"))
    return t.groupBy("dataset").agg(F.round(F.avg(x), 6).alias("total"), F.count("*").alias("n"))


# ---------------------------------------------------------------- titles, links, pages

_PREFIX = " OR ".join(f"starts_with(l, '{p}')" for p in T.LIST_PREFIXES + T.NAMESPACE_PREFIXES)
_VALID = f"coalesce(length(t) >= 3 AND NOT ({_PREFIX}) AND NOT contains(l, '(disambiguation)'), false)"


@query(f"""WITH x AS (SELECT title AS t, trim(replace(lower(title), 'ß', 'ss')) AS l FROM page_nodes UNION ALL SELECT page_title, trim(replace(lower(page_title), 'ß', 'ss')) FROM documents)
    SELECT t AS title, {_VALID} AS valid, count(*) AS n FROM x GROUP BY ALL""")
def title_filter(spark: SparkSession, d: str) -> DataFrame:
    """Titles of pages and documents, and whether they may name an entity."""
    t = table(spark, d, "page_nodes").select("title").unionByName(table(spark, d, "documents").select(F.col("page_title").alias("title")))
    return t.groupBy("title").agg(F.count("*").alias("n")).select("title", T.valid_title(F.col("title")).alias("valid"), "n")


_DOMAIN = " ".join(f"WHEN {' OR '.join(f'contains(x, $${w}$$)' for w in words)} THEN '{name}'" for name, words in T.DOMAIN_WORDS)


@query(f"""WITH x AS (SELECT page_id, replace(lower(' ' || left(coalesce(extract, ''), 1800)), 'ß', 'ss') AS x FROM page_nodes)
    SELECT page_id, CASE {_DOMAIN} ELSE 'artifact' END AS domain FROM x""")
def domain_classifier(spark: SparkSession, d: str) -> DataFrame:
    """The domain of each page by the keywords of its extract."""
    return table(spark, d, "page_nodes").select("page_id", T.infer_domain(F.col("extract")).alias("domain"))


@query(r"""WITH x AS (SELECT cache_id, regexp_extract_all(coalesce(value, ''), '\[[^\]\n]*\]\((https?://[^)\s#]+)', 1) AS l FROM tool_cache WHERE namespace = 'page'
    ), y AS (SELECT cache_id, unnest(generate_series(1, len(l))) AS pos, unnest(l) AS link FROM x)
    SELECT cache_id, link, min(pos) AS pos FROM y GROUP BY ALL""")
def link_extract(spark: SparkSession, d: str) -> DataFrame:
    """Links of each read page, each once, in order."""
    links = F.regexp_extract_all(F.coalesce("value", F.lit("")), F.lit(r"\[[^\]\n]*\]\((https?://[^)\s#]+)"), 1)
    x = table(spark, d, "tool_cache").where("namespace = 'page'").select("cache_id", F.posexplode(links).alias("pos", "link"))
    return x.groupBy("cache_id", "link").agg((F.min("pos") + 1).cast("bigint").alias("pos"))


@query(r"""WITH p AS (SELECT message_id, unnest(content) AS c FROM sft_messages), t AS (SELECT message_id, c.text AS x FROM p WHERE contains(c.text, '<html>'))
    SELECT message_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '(?is)<script.*?</script\s*>|<style.*?</style\s*>|<noscript.*?</noscript\s*>|<svg.*?</svg\s*>', chr(10), 'g'), '<[^>]*>', chr(10), 'g'), '[ \t\r]*\n[\s]*', chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM t""")
def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    """The text of messages that are pages of HTML."""
    p = table(spark, d, "sft_messages").select("message_id", F.explode("content").alias("c")).where(F.contains(F.col("c.text"), F.lit("<html>")))
    return p.select("message_id", T.html_to_text(F.col("c.text")).alias("text"))


@query(f"""WITH e AS (SELECT DISTINCT title AS src, o.title AS dst FROM (SELECT title, unnest(outgoing) AS o FROM page_nodes WHERE title IS NOT NULL)), v AS (SELECT src, dst, dst AS t, trim(replace(lower(dst), 'ß', 'ss')) AS l FROM e)
    SELECT dst, count(*) AS degree, count(*) BETWEEN 3 AND 10000 AS in_band FROM v WHERE {_VALID} GROUP BY dst""")
def in_degree_band(spark: SparkSession, d: str) -> DataFrame:
    """How many pages link to each title, and whether that lies in a band."""
    g = N.in_degree(N.edges(table(spark, d, "page_nodes")))
    return g.select("dst", "degree", N.seed_ok(F.col("degree"), 3, 10_000).alias("in_band"))


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    """One row per title: the row fetched last."""
    return R.latest(table(spark, d, "page_nodes").where("title is not null").select("title", "outgoing", "incoming_links", "extract", "page_id"), ["title"], "page_id")


_NODES = "n AS (SELECT title, m.o AS outgoing, coalesce(m.i, -1) AS incoming FROM (SELECT title, arg_max(struct_pack(o := outgoing, i := incoming_links), page_id) AS m FROM page_nodes WHERE title IS NOT NULL GROUP BY title))"


@query(f"""WITH {_NODES}, x AS (SELECT title AS src, unnest(generate_series(0, len(outgoing) - 1)) AS pos, unnest(outgoing) AS o FROM n
    ), f AS (SELECT src, o.title AS dst, min(pos) AS pos FROM (SELECT *, o.title AS t, trim(replace(lower(o.title), 'ß', 'ss')) AS l FROM x) WHERE {_VALID} GROUP BY 1, 2
    ), e AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY src ORDER BY pos) <= {N.MOST_LINKS}
    ), k AS (SELECT e.src, e.dst FROM e JOIN n ON n.title = e.dst WHERE n.incoming BETWEEN 0 AND 10000 QUALIFY row_number() OVER (PARTITION BY e.src ORDER BY e.pos) <= {N.MOST_CANDIDATES}
    ), s AS (SELECT title FROM n WHERE incoming BETWEEN 50 AND 10000)
    SELECT 2 AS hops, count(*) AS paths, count(DISTINCT s.title) AS starts FROM s JOIN k a ON a.src = s.title JOIN k b ON b.src = a.dst WHERE a.dst <> s.title AND b.dst NOT IN (s.title, a.dst)
    UNION ALL
    SELECT 3, count(*), count(DISTINCT s.title) FROM s JOIN k a ON a.src = s.title JOIN k b ON b.src = a.dst JOIN k c ON c.src = b.dst
    WHERE a.dst <> s.title AND b.dst NOT IN (s.title, a.dst) AND c.dst NOT IN (s.title, a.dst, b.dst)
    UNION ALL
    SELECT 4, count(*), count(DISTINCT s.title) FROM s JOIN k a ON a.src = s.title JOIN k b ON b.src = a.dst JOIN k c ON c.src = b.dst JOIN k g ON g.src = c.dst
    WHERE a.dst <> s.title AND b.dst NOT IN (s.title, a.dst) AND c.dst NOT IN (s.title, a.dst, b.dst) AND g.dst NOT IN (s.title, a.dst, b.dst, c.dst)""")
def two_to_four_hop_paths(spark: SparkSession, d: str) -> DataFrame:
    """Acyclic paths of two, three and four links from pages in the band, through pages that are no hubs."""
    n = _nodes(spark, d)
    known = n.where(F.col("incoming_links").between(0, N.HUB_CAP)).select(F.col("title").alias("dst"))
    links = N.edges(n).join(known, "dst", "left_semi")
    starts = n.where(N.seed_ok(F.col("incoming_links"))).select("title")
    out = None
    for hops, p in N.path_levels(starts, links, 2, 4).items():
        c = p.agg(F.count("*").alias("paths"), F.countDistinct(F.element_at("path", 1)).alias("starts")).select(F.lit(hops).alias("hops"), "paths", "starts")
        out = c if out is None else out.unionByName(c)
    return out


@query(f"""WITH {_NODES}, x AS (SELECT title AS src, unnest(generate_series(0, len(outgoing) - 1)) AS pos, unnest(outgoing) AS o FROM n
    ), f AS (SELECT src, o.title AS dst, min(pos) AS pos FROM (SELECT *, o.title AS t, trim(replace(lower(o.title), 'ß', 'ss')) AS l FROM x) WHERE {_VALID} GROUP BY 1, 2
    ), e AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY src ORDER BY pos) <= {N.MOST_LINKS}
    ), k AS (SELECT e.src, e.dst FROM e JOIN n ON n.title = e.dst WHERE n.incoming BETWEEN 0 AND 10000
    ), u AS (SELECT title, {_UNIT.format('3407', 'title')} AS u FROM n WHERE incoming BETWEEN 50 AND 10000
    ), s0 AS (SELECT title, CASE WHEN u < 0.4 THEN 2 WHEN u < 0.8 THEN 3 ELSE 4 END AS hops, [title] AS path, false AS dead FROM u
    ), b1 AS (SELECT p.title, arg_min(k.dst, md5('3407|1|' || p.title || '|' || k.dst)) AS b FROM s0 p JOIN k ON k.src = p.path[-1] WHERE p.hops >= 1 AND NOT p.dead AND NOT list_contains(p.path, k.dst) GROUP BY p.title
    ), s1 AS (SELECT p.title, p.hops, CASE WHEN b IS NULL THEN p.path ELSE list_append(p.path, b) END AS path, p.dead OR (p.hops >= 1 AND b IS NULL) AS dead FROM s0 p LEFT JOIN b1 USING (title)
    ), b2 AS (SELECT p.title, arg_min(k.dst, md5('3407|2|' || p.title || '|' || k.dst)) AS b FROM s1 p JOIN k ON k.src = p.path[-1] WHERE p.hops >= 2 AND NOT p.dead AND NOT list_contains(p.path, k.dst) GROUP BY p.title
    ), s2 AS (SELECT p.title, p.hops, CASE WHEN b IS NULL THEN p.path ELSE list_append(p.path, b) END AS path, p.dead OR (p.hops >= 2 AND b IS NULL) AS dead FROM s1 p LEFT JOIN b2 USING (title)
    ), b3 AS (SELECT p.title, arg_min(k.dst, md5('3407|3|' || p.title || '|' || k.dst)) AS b FROM s2 p JOIN k ON k.src = p.path[-1] WHERE p.hops >= 3 AND NOT p.dead AND NOT list_contains(p.path, k.dst) GROUP BY p.title
    ), s3 AS (SELECT p.title, p.hops, CASE WHEN b IS NULL THEN p.path ELSE list_append(p.path, b) END AS path, p.dead OR (p.hops >= 3 AND b IS NULL) AS dead FROM s2 p LEFT JOIN b3 USING (title)
    ), b4 AS (SELECT p.title, arg_min(k.dst, md5('3407|4|' || p.title || '|' || k.dst)) AS b FROM s3 p JOIN k ON k.src = p.path[-1] WHERE p.hops >= 4 AND NOT p.dead AND NOT list_contains(p.path, k.dst) GROUP BY p.title
    ), s4 AS (SELECT p.title, p.hops, CASE WHEN b IS NULL THEN p.path ELSE list_append(p.path, b) END AS path, p.dead OR (p.hops >= 4 AND b IS NULL) AS dead FROM s3 p LEFT JOIN b4 USING (title)
    )
    SELECT title, hops, array_to_string(path, ' > ') AS path, len(path) = hops + 1 AS complete FROM s4""")
def random_walk(spark: SparkSession, d: str) -> DataFrame:
    """One walk from each page in the band."""
    n = _nodes(spark, d)
    known = n.where(F.col("incoming_links") <= N.HUB_CAP).select(F.col("title").alias("dst"))
    w = N.walks(n.where(N.seed_ok(F.col("incoming_links"))).select("title"), N.edges(n).join(known, "dst", "left_semi"), "3407")
    return w.select("title", "hops", F.array_join("path", " > ").alias("path"), "complete")


@query(f"""WITH x AS (SELECT page_id, coalesce(incoming_links, -1) AS i, coalesce(length({_sq('extract')}), 0) AS l FROM page_nodes)
    SELECT page_id, i BETWEEN 50 AND 10000 AS seed_ok, i BETWEEN 0 AND 10000 AND l >= 200 AS node_ok FROM x""")
def page_eligibility(spark: SparkSession, d: str) -> DataFrame:
    """Whether a page may start a path or lie on one."""
    return table(spark, d, "page_nodes").select("page_id", N.seed_ok(F.col("incoming_links")).alias("seed_ok"), N.node_ok(F.col("incoming_links"), F.col("extract")).alias("node_ok"))


# ---------------------------------------------------------------- similarity and retrieval

_COS = """WITH q AS (SELECT vec_id AS query_id, embedding::double[] AS e FROM embeddings WHERE vec_id % 100 = 0), b AS (SELECT vec_id, embedding::double[] AS e FROM embeddings)
    , s AS (SELECT query_id, vec_id, list_cosine_similarity(q.e, b.e) AS score FROM q, b WHERE query_id <> vec_id)
    , r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s)"""


@query(f"{_COS} SELECT query_id, vec_id, round(score, 6) AS score FROM r WHERE rank = 1 AND score >= 0.28")
def cosine_argmax(spark: SparkSession, d: str) -> DataFrame:
    """The nearest vector of every hundredth, if it is near enough."""
    e = table(spark, d, "embeddings")
    return S.top_k(e.where("vec_id % 100 = 0"), e, 1, least=0.28).select("query_id", "vec_id", F.round("score", 6).alias("score"))


@query(f"{_COS} SELECT query_id, rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= 10")
def topk_per_query(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest vectors of every hundredth one, among all."""
    e = table(spark, d, "embeddings")
    return S.top_k(e.where("vec_id % 100 = 0"), e, 10).select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


@query(f"""WITH q AS (SELECT DISTINCT page_id, unnest(string_split({_norm('title')}, ' ')) AS term FROM hub_pages), w AS (SELECT DISTINCT doc_id, unnest(string_split({_norm('text')}, ' ')) AS term FROM documents WHERE text IS NOT NULL)
    , h AS (SELECT page_id, doc_id, count(*) AS hits FROM q JOIN w USING (term) WHERE term <> '' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY hits DESC, doc_id) AS rank FROM h)
    SELECT page_id, doc_id, hits, rank FROM r WHERE rank <= 10""")
def term_search_topk(spark: SparkSession, d: str) -> DataFrame:
    """The documents that share most words with the title of each hub page."""
    return R.term_search(table(spark, d, "hub_pages"), table(spark, d, "documents"), 10, "page_id", "title", "doc_id", "text")


_CALLS = f"WITH {_TURNS}, c AS (SELECT traj_id, turn, x.function.name AS name, x.function.arguments AS a FROM (SELECT traj_id, turn, unnest(tool_calls) AS x FROM turns))"
_PUNCT = r"""[\\/|,;:!?()\[\]{}<>"''`~]+"""


@query(f"""{_CALLS}, q AS (SELECT traj_id, turn, regexp_replace({_sq("coalesce(json_extract_string(a, '$.q'), '')")}, '^{_PUNCT}|{_PUNCT}$', '', 'g') AS s FROM c)
    SELECT traj_id, turn, CASE WHEN length(s) >= 2 AND regexp_matches(s, '[\\p{{L}}\\p{{N}}]') THEN left(s, 512) END AS query FROM q""")
def query_normalise(spark: SparkSession, d: str) -> DataFrame:
    """The query of each tool call in normal form."""
    c = C.calls(table(spark, d, "trajectories"))
    return c.select("traj_id", "turn", T.query_text(F.get_json_object("arguments", "$.q")).alias("query"))


@query(f"""{_CALLS} SELECT traj_id, turn, sha256(lower(json_extract_string(a, '$.q')) || chr(10) || json_extract_string(a, '$.top_k')) AS key FROM c
    WHERE json_extract_string(a, '$.q') IS NOT NULL AND json_extract_string(a, '$.top_k') IS NOT NULL""")
def cache_key_sha256(spark: SparkSession, d: str) -> DataFrame:
    """The cache key of each search."""
    c = C.calls(table(spark, d, "trajectories")).withColumn("q", F.get_json_object("arguments", "$.q")).withColumn("k", F.get_json_object("arguments", "$.top_k"))
    return c.where("q is not null and k is not null").select("traj_id", "turn", T.search_key(F.col("q"), F.col("k")).alias("key"))


@query("""WITH l AS (SELECT namespace, cache_key, arg_max(struct_pack(cache_id := cache_id, at := updated_at), struct_pack(a := updated_at, b := cache_id)) AS m FROM tool_cache WHERE updated_at IS NOT NULL GROUP BY ALL)
    SELECT namespace, cache_key, m.cache_id AS cache_id FROM l WHERE (SELECT max(updated_at) FROM tool_cache) - m.at <= 604800""")
def cache_ttl_latest(spark: SparkSession, d: str) -> DataFrame:
    """The last write of each cache key that is no older than a week at the time of the last write of all."""
    t = table(spark, d, "tool_cache").where("updated_at is not null").select("namespace", "cache_key", "cache_id", "updated_at")
    now = t.agg(F.max("updated_at")).scalar()
    return R.live(R.latest(t, ["namespace", "cache_key"], tie="cache_id"), now).select("namespace", "cache_key", "cache_id")


@query("""SELECT page_id, CASE WHEN coalesce(extract, '') <> '' THEN 'extract' WHEN coalesce(title, '') <> '' THEN 'title' WHEN coalesce(url, '') <> '' THEN 'url' END AS provider,
    cast(length(CASE WHEN coalesce(extract, '') <> '' THEN extract WHEN coalesce(title, '') <> '' THEN title ELSE url END) AS bigint) AS chars FROM page_nodes""")
def fallback_chain(spark: SparkSession, d: str) -> DataFrame:
    """What a page is read from: extract, else title, else address."""
    r = R.fallback([(c, F.col(c), F.lit("no content")) for c in ("extract", "title", "url")])
    return table(spark, d, "page_nodes").select("page_id", r.alias("r")).select("page_id", "r.provider", F.length("r.content").cast("bigint").alias("chars"))


@query("""WITH l AS (SELECT namespace, cache_key, min(cache_id) AS first FROM tool_cache GROUP BY ALL)
    SELECT t.cache_id, t.cache_id <> l.first AS hit FROM tool_cache t JOIN l ON t.namespace IS NOT DISTINCT FROM l.namespace AND t.cache_key IS NOT DISTINCT FROM l.cache_key""")
def cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Whether each write found its key stored before."""
    w = Window.partitionBy("namespace", "cache_key")
    return table(spark, d, "tool_cache").select("cache_id", (F.col("cache_id") != F.min("cache_id").over(w)).alias("hit"))


@query("""WITH n AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM events), s AS (SELECT user_id, min(no) AS no FROM n WHERE event_type <> 'error' OR no >= 2 GROUP BY user_id)
    SELECT s.user_id, s.no AS attempts, n.event_type <> 'error' AS succeeded FROM s JOIN n USING (user_id, no)""")
def retry_outcome(spark: SparkSession, d: str) -> DataFrame:
    """Attempts until the first success, two at most."""
    e = table(spark, d, "events").withColumn("ok", F.col("event_type") != "error").withColumn("again", F.lit(True))
    return R.retries(e, "user_id", ["ts", "event_id"], "ok", "again")


@query("""SELECT event_id, coalesce(bool_or(event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS tripped FROM events""")
def sticky_flag(spark: SparkSession, d: str) -> DataFrame:
    """Whether a user had an error before each event."""
    e = table(spark, d, "events").withColumn("bad", F.col("event_type") == "error")
    return R.sticky(e, "user_id", ["ts", "event_id"], "bad").select("event_id", "tripped")


# ---------------------------------------------------------------- JSON and tool calls


@query("SELECT cast(json_extract_string(props, '$.k') AS bigint) AS k, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    """Events by a property held as JSON."""
    return table(spark, d, "events").groupBy(F.get_json_object("props", "$.k").try_cast("bigint").alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))


@query(f"""WITH {_ROWS}, x AS (SELECT row_id, turn, regexp_extract(text, '(?s)<tool_call>\\s*(\\{{.*?\\}})\\s*</tool_call>', 1) AS j, {_strip("split_part(text, '<tool_call>', 1)")} AS before FROM s WHERE role = 'assistant' AND contains(text, '<tool_call>'))
    SELECT row_id, turn, json_extract_string(j, '$.name') AS name, CASE WHEN json_extract_string(j, '$.name') IN ('text_search', 'web_search') THEN json_extract_string(j, '$.arguments.q') END AS q, before AS content
    FROM x WHERE j <> '' AND json_valid(j) AND json_extract_string(j, '$.name') IS NOT NULL""")
def tool_call_parse(spark: SparkSession, d: str) -> DataFrame:
    """The first tool call in the text of each assistant turn that has one."""
    s = _sft_turns(spark, d).where("role = 'assistant'").withColumn("c", T.parse_tool_call(F.col("text"))).where("c.name is not null")
    q = F.when(F.col("c.name").isin("text_search", "web_search"), F.get_json_object("c.arguments", "$.q"))
    return s.select("row_id", "turn", "c.name", q.alias("q"), "c.content")


@query(f"""{_CALLS} SELECT name, count(*) AS calls, name IN ('text_search', 'image_search', 'web_search', 'crop', 'layout_parsing', 'sharpen', 'super_resolution', 'perspective_correct') AS in_contract FROM c WHERE name IS NOT NULL GROUP BY name""")
def contract_tools(spark: SparkSession, d: str) -> DataFrame:
    """Tools called, and whether the contract has them."""
    contract = ["text_search", "image_search", "web_search", "crop", "layout_parsing", "sharpen", "super_resolution", "perspective_correct"]
    return A.contract_diff(C.calls(table(spark, d, "trajectories")), "name", contract)


@query(f"""{_CALLS} SELECT traj_id, turn, CASE WHEN starts_with(a, 'data:') THEN '<data-uri:' || length(a) || ' chars>' ELSE left(a, 500) END AS arguments FROM c""")
def scrub_truncate(spark: SparkSession, d: str) -> DataFrame:
    """Arguments of calls as they go to a log."""
    return C.calls(table(spark, d, "trajectories")).select("traj_id", "turn", T.scrub(F.col("arguments")).alias("arguments"))


@query(f"""{_CALLS}, i AS (SELECT traj_id, turn, coalesce(json_extract_string(a, '$.image'), json_extract_string(a, '$.url')) AS ref FROM c)
    SELECT traj_id, turn, ref, CASE WHEN regexp_matches(ref, '(?i)^(https?://|file://|artifact://|data:)') THEN ref ELSE 'file:///input.png' END AS uri FROM i WHERE ref IS NOT NULL""")
def image_reference(spark: SparkSession, d: str) -> DataFrame:
    """Image references of calls against the one image of a run."""
    c = C.calls(table(spark, d, "trajectories")).withColumn("ref", F.coalesce(F.get_json_object("arguments", "$.image"), F.get_json_object("arguments", "$.url"))).where("ref is not null")
    return c.select("traj_id", "turn", "ref", I.resolve(F.col("ref"), F.array(F.lit("file:///input.png")))["uri"].alias("uri"))


@query("""SELECT l_orderkey, l_linenumber, greatest(l_suppkey - 50, 0) AS left_, greatest(l_linenumber - 2, 0) AS top, least(greatest(l_suppkey - 50, 0) + cast(l_quantity AS bigint), 60) AS right_,
    least(greatest(l_linenumber - 2, 0) + 3, 4) AS bottom, least(greatest(l_suppkey - 50, 0) + cast(l_quantity AS bigint), 60) <= greatest(l_suppkey - 50, 0) OR least(greatest(l_linenumber - 2, 0) + 3, 4) <= greatest(l_linenumber - 2, 0) AS empty FROM lineitem""")
def crop_clamp(spark: SparkSession, d: str) -> DataFrame:
    """Rectangles clipped to a picture of 60 by 4."""
    r = I.crop(F.col("l_suppkey") - 50, F.col("l_linenumber") - 2, F.col("l_quantity").cast("bigint"), F.lit(3), F.lit(60).cast("bigint"), F.lit(4))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r.alias("r")).select("l_orderkey", "l_linenumber", F.col("r.left").alias("left_"), "r.top", F.col("r.right").alias("right_"), "r.bottom", F.col("r.error").isNotNull().alias("empty"))


@query("""SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey, l_partkey) - 1 AS reading_order
    FROM (SELECT l_orderkey, l_partkey, l_suppkey, max(l_linenumber) AS l_linenumber FROM lineitem GROUP BY ALL)""")
def reading_order(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of a page in the order in which they are read."""
    b = table(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey", "l_suppkey").agg(F.max("l_linenumber").alias("l_linenumber"))
    b = b.withColumn("box", F.array(F.array(F.col("l_partkey") + 5, F.col("l_suppkey")), F.array("l_partkey", F.col("l_suppkey") + 3)))
    return I.reading_order(b, "l_orderkey").select("l_orderkey", "l_linenumber", "reading_order")


# ---------------------------------------------------------------- events and relational extras


@query("""SELECT time_bucket(INTERVAL 1 DAY, ts) AS begin, event_type, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY ALL""")
def tumbling_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events of each day and type."""
    e = table(spark, d, "events")
    g = e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("value"))
    return g.select(F.col("w.start").alias("begin"), "event_type", "events", "value")


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
    SELECT user_id, cast(session AS bigint) AS session, min(ts) AS begin, max(ts) AS end_, count(*) AS events FROM s GROUP BY ALL""")
def session_windows(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of users that two hours of silence end."""
    return X.sessions(table(spark, d, "events"), "user_id", "ts", 7200).select("user_id", F.col("session").cast("bigint").alias("session"), "begin", F.col("end").alias("end_"), "events")


@query("""SELECT event_id, (SELECT arg_max(o_orderkey, struct_pack(a := o_orderdate, b := o_orderkey)) FROM orders WHERE o_custkey = user_id AND o_orderdate <= ts + INTERVAL 0 DAY) AS last_order FROM events""")
def asof_join(spark: SparkSession, d: str) -> DataFrame:
    """The last order of the customer of each event at its time."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), "o_orderdate", "o_orderkey")
    o = o.groupBy("user_id", "o_orderdate").agg(F.max("o_orderkey").alias("last_order"))
    e = table(spark, d, "events").select("event_id", "user_id", "ts")
    return X.asof(e, o, "user_id", "ts", "o_orderdate", ["last_order"]).select("event_id", "last_order")


@query("SELECT s.n_wanted, count(*) AS events FROM events JOIN subset_requests s ON value >= s.n_wanted AND value < s.n_wanted + 10 GROUP BY 1")
def range_join(spark: SparkSession, d: str) -> DataFrame:
    """Events whose value lies in a range that a request opens."""
    r = table(spark, d, "subset_requests").select("n_wanted", F.col("n_wanted").cast("double").alias("low"), (F.col("n_wanted") + 10).cast("double").alias("high"))
    return X.range_join(table(spark, d, "events").select("value"), "value", r, "low", "high", 10.0).groupBy("n_wanted").agg(F.count("*").alias("events"))


@query("""SELECT 'both' AS kind, count(*) AS n FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)
    UNION ALL SELECT 'customers only', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)
    UNION ALL SELECT 'either', count(*) FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)""")
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of an intersection, a difference and a union."""
    c, s, o = table(spark, d, "customer"), table(spark, d, "supplier"), table(spark, d, "orders")
    n = lambda df, k: df.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n")
    both, either = c.select("c_nationkey").intersect(s.select("s_nationkey")), c.select("c_nationkey").union(s.select("s_nationkey")).distinct()
    return n(both, "both").unionByName(n(c.select("c_custkey").subtract(o.select("o_custkey")), "customers only")).unionByName(n(either, "either"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_totals(spark: SparkSession, d: str) -> DataFrame:
    """Quantities by flag and status, with all subtotals."""
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
    JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name""")
def star_join(spark: SparkSession, d: str) -> DataFrame:
    """Revenue of suppliers from customers of their own nation."""
    c, o, l = table(spark, d, "customer"), table(spark, d, "orders"), table(spark, d, "lineitem")
    s, n, r = table(spark, d, "supplier"), table(spark, d, "nation"), table(spark, d, "region")
    j = c.join(o, c.c_custkey == o.o_custkey).join(l, l.l_orderkey == o.o_orderkey).join(s, (l.l_suppkey == s.s_suppkey) & (c.c_nationkey == s.s_nationkey))
    j = j.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query(f"""SELECT traj_id, {_strip(f"array_to_string(list_filter(list_transform(list_filter(messages, lambda m: m.role = 'user'), lambda m: coalesce(array_to_string(list_transform(list_filter(m.content, lambda p: p.type = 'text' AND p.text IS NOT NULL), lambda p: p.text), chr(10)), '')), lambda x: x <> ''), chr(10))")} AS question FROM trajectories""")
def question_text(spark: SparkSession, d: str) -> DataFrame:
    """The question of each trajectory."""
    return table(spark, d, "trajectories").select("traj_id", F.coalesce(D.question_text(F.col("messages")), F.lit("")).alias("question"))


@query("""SELECT traj_id, coalesce(array_to_string(list_transform(list_filter(list_filter(messages, lambda m: m.role = 'assistant' AND m.content IS NOT NULL)[-1].content, lambda p: p.type = 'text' AND p.text IS NOT NULL), lambda p: p.text), ''), '') AS text FROM trajectories""")
def last_assistant_text(spark: SparkSession, d: str) -> DataFrame:
    """The last words of the assistant in each trajectory."""
    return table(spark, d, "trajectories").select("traj_id", D.last_assistant_text(F.col("messages")).alias("text"))


@query(f"{_CALLS}, n AS (SELECT traj_id, name, count(*) AS n FROM c GROUP BY ALL) SELECT traj_id, name, n AS calls FROM n")
def call_counts_map(spark: SparkSession, d: str) -> DataFrame:
    """Calls of each tool, gathered in a map per trajectory and unfolded again."""
    n = C.calls(table(spark, d, "trajectories")).groupBy("traj_id", "name").agg(F.count("*").alias("n"))
    m = n.groupBy("traj_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "n"))).alias("m"))
    return m.select("traj_id", F.explode("m").alias("name", "calls"))


@query(f"""{_CALLS} SELECT coalesce(regexp_extract(json_extract_string(a, '$.url'), '^([A-Za-z][A-Za-z0-9+.-]*)://', 1), '') AS scheme, count(*) AS n FROM c WHERE json_extract_string(a, '$.url') IS NOT NULL GROUP BY 1""")
def url_schemes(spark: SparkSession, d: str) -> DataFrame:
    """Schemes of the addresses in calls; none for names of images."""
    u = C.calls(table(spark, d, "trajectories")).select(F.get_json_object("arguments", "$.url").alias("u")).where("u is not null")
    return u.groupBy(F.when(D.has_scheme(F.col("u")), I.scheme(F.col("u"))).otherwise("").alias("scheme")).agg(F.count("*").alias("n"))


@query("SELECT cache_id, coalesce(nullif(regexp_replace(coalesce(value, ''), '^\\s+|\\s+$', '', 'g'), ''), left(cache_key, 4000)) AS text FROM tool_cache WHERE namespace = 'caption'")
def summary_fallback(spark: SparkSession, d: str) -> DataFrame:
    """The value of each caption entry, or its key where there is none."""
    return table(spark, d, "tool_cache").where("namespace = 'caption'").select("cache_id", D.summary_or_text(F.col("value"), F.col("cache_key")).alias("text"))


@query(f"""WITH {_TURNS}, u AS (SELECT traj_id, row_number() OVER (PARTITION BY traj_id ORDER BY turn) AS pos, turn AS asked FROM turns WHERE role = 'assistant'), r AS (SELECT traj_id, row_number() OVER (PARTITION BY traj_id ORDER BY turn) AS pos, turn AS answered FROM turns WHERE role = 'tool')
    SELECT coalesce(u.traj_id, r.traj_id) AS traj_id, coalesce(u.pos, r.pos) AS pos, asked, answered, CASE WHEN u.pos IS NULL OR r.pos IS NULL THEN 'lengths differ' END AS error FROM u FULL JOIN r ON u.traj_id = r.traj_id AND u.pos = r.pos""")
def positional_zip(spark: SparkSession, d: str) -> DataFrame:
    """Assistant turns and tool results of a trajectory by position."""
    t = C.turns(table(spark, d, "trajectories"))
    pos = F.row_number().over(Window.partitionBy("traj_id").orderBy("turn")).cast("bigint")
    a = t.where("role = 'assistant'").select("traj_id", pos.alias("pos"), F.col("turn").alias("asked"))
    r = t.where("role = 'tool'").select("traj_id", pos.alias("pos"), F.col("turn").alias("answered"))
    return D.zip_positions(a, r, ["traj_id", "pos"])


@query()
def scrub_json(spark: SparkSession, d: str) -> DataFrame:
    """Arguments of calls as they go to a log, scrubbed at any depth."""
    return C.calls(table(spark, d, "trajectories")).select("traj_id", "turn", D.scrub_json(F.col("arguments")).alias("arguments"))


@query("""SELECT time_bucket(INTERVAL 1 DAY, ts) AS begin, event_type, count(*) AS events FROM events GROUP BY ALL""")
def streamed_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events of each day and type, counted by a stream over the table's files that ends when all are read; a row per window and type is kept."""
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d.rstrip('/')}/events.parquet*")
    # a watermark needs a zone: the times are read as UTC and written back, whatever the session's zone is
    w = E.windowed(stream.withColumn("ts", F.timestamp_micros(X.micros(F.col("ts")))), "ts", "1 hour", "1 day", by=["event_type"])
    out = f"{shared_dir(spark).rstrip('/')}/streamed-{uuid.uuid4().hex}"
    q = w.writeStream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{out}/rows")).option("checkpointLocation", f"{out}/state").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(w.schema).parquet(f"{out}/rows").select(X.from_micros(F.unix_micros("begin")).alias("begin"), "event_type", "events")
