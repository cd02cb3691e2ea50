"""Queries over dialogs and tool events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vector import padded
from ..operators import intervals, ranking
from ..operators import trajectory as J
from ..sources.tables import table


def turns(spark, d):
    return table(spark, d, "conversations")


def wrapped(spark, d):
    """The tables' dialogs hold no tags, so each text is put into them."""
    text = F.coalesce("text", F.lit(""))
    return turns(spark, d).select("conv_id", "turn", "role", text.alias("plain"), F.concat(F.lit("<think>hm</think> <Answer> "), text, F.lit(" </ANSWER> Task marker: "), text, F.lit("\nStop here. end")).alias("t"))


WRAPPED = "w AS (SELECT conv_id, turn, role, coalesce(text, '') AS plain, '<think>hm</think> <Answer> ' || coalesce(text, '') || ' </ANSWER> Task marker: ' || coalesce(text, '') || chr(10) || 'Stop here. end' AS t FROM conversations)"


def tag_extract(spark, d):
    t = F.col("t")
    body = T.tag_body(t, "answer")
    return wrapped(spark, d).select("conv_id", "turn", body.alias("answer"), T.has_tag(t, "think").alias("has_think"), T.has_tag(t, "answer").alias("has_answer"), T.letters(body).alias("answer_letters"))


def requirement_after_marker(spark, d):
    after = T.after_last(F.col("t"), "Task marker:")
    return wrapped(spark, d).select("conv_id", "turn", F.trim(T.before_first(after, ["Stop here", "###"])).alias("requirement"))


def event_rows(spark, d):
    e = table(spark, d, "events")
    return e.select("user_id", "event_id", "ts", F.col("event_type").alias("tool"), (F.col("event_type") != "error").alias("success"), (F.col("value") / 10).alias("score"))


EVENTS = "e AS (SELECT user_id, event_id, ts, event_type AS tool, event_type <> 'error' AS success, value / 10 AS score FROM events)"


def tool_event_parse(spark, d):
    """Events written as texts by one operator and read back by the other."""
    e = event_rows(spark, d)
    text = F.concat(F.lit("<tool_response>"), J.observation(F.col("tool"), F.col("event_id") % 7, F.col("score"), F.col("score") + 1), F.lit("</tool_response> x <tool_response>failed</tool_response>"))
    return J.tool_events(e.withColumn("t", text), ["event_id"], "t").select("event_id", F.col("event").cast("long").alias("event"), "tool_name", "success", "num_scored", "best_round", "global_best")


def reward_mild(spark, d):
    return J.reward_mild(event_rows(spark, d), "user_id").select("user_id", F.round("r_tools", 6).alias("r_tools"), F.round("best", 6).alias("best"), "n_events", F.round("reward", 6).alias("reward"))


def reward_capped(spark, d):
    r = J.reward_capped(event_rows(spark, d), "user_id", ["ts", "event_id"], F.col("tool") == "click")
    return r.select("user_id", F.round("r_tools", 6).alias("r_tools"), F.round("best", 6).alias("best"), "n_stage", F.round("reward", 6).alias("reward"))


def overlong_penalty(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(J.overlong_penalty(F.length("text"), 4096, 1024, 1.0), 6).alias("penalty"))


def role_fix(spark, d):
    t = turns(spark, d).withColumn("calls_tool", (F.col("role") == "assistant") & F.contains(F.coalesce("text", F.lit("")), F.lit("the"))).withColumn("looks_like_result", F.coalesce("text", F.lit("")).rlike("[.,]"))
    return J.repaired_roles(t, "conv_id", "turn").select("conv_id", "turn", "fixed_role")


def tool_blocks(spark, d):
    t = turns(spark, d).withColumn("kind", F.col("role") == "system")
    return intervals.consecutive_blocks(t, ["conv_id"], "turn", "kind").select("conv_id", "kind", "first", "last", "n")


def last_user_turn(spark, d):
    last = J.last_turn(turns(spark, d), "conv_id", "turn", F.col("role") == "user")
    first = turns(spark, d).filter("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("first_text"))
    return last.join(first, "conv_id")


def role_validation(spark, d):
    bad = (F.col("role") == "system") & (F.col("turn") > 0) | ~F.col("role").isin("system", "user", "assistant", "tool")
    return turns(spark, d).groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.count_if(F.coalesce(bad, F.lit(True))).alias("n_bad"), F.count_if(F.col("role") == "assistant").alias("n_assistant"))


def session_key_hash(spark, d):
    t = turns(spark, d).withColumn("id", F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("Session /"), F.col("conv_id").cast("string"))).when(F.col("conv_id") % 3 == 1, F.lit(" ")))
    key = J.session_key(F.col("id"), text=F.coalesce("text", F.lit("")))
    return t.select("conv_id", "turn", key.alias("session"), F.concat(T.slug(key), F.lit("-"), T.short_hash(key)).alias("folder"))


def props_json(spark, d):
    """Fields of valid JSON, of its single-quoted form and of text that is neither."""
    e = table(spark, d, "events").select("event_id", "props")
    loose = F.when(F.col("event_id") % 3 == 0, F.translate("props", '"', "'")).when(F.col("event_id") % 3 == 1, F.col("props")).otherwise(F.concat(F.lit("not json "), F.col("props")))
    fields = ["k", "session", "page", "a"]
    return e.select("event_id", *[T.py_literal_field(loose, f).alias(f"f_{f}") for f in fields], F.length("props").alias("n"))


def tool_call_parse(spark, d):
    text = F.concat(F.lit("I call <tool_call> {\"name\": \""), F.col("event_type"), F.lit("\", \"arguments\": {\"v\": "), F.col("event_id").cast("string"), F.lit("}} </tool_call> <tool_call>{}</tool_call>"))
    body = F.regexp_extract(text, r"(?is)<tool_call>\s*(\{.*?\})\s*</tool_call>", 1)
    return table(spark, d, "events").select("event_id", F.get_json_object(body, "$.name").alias("name"), F.get_json_object(body, "$.arguments.v").try_cast("long").alias("v"))


def running_best_delta(spark, d):
    r = ranking.running_best(event_rows(spark, d).filter("success"), "user_id", ["ts", "event_id"], "score")
    return r.select("user_id", "event_id", F.round("best", 6).alias("best"), F.round("prev_best", 6).alias("prev_best"), F.round("delta", 6).alias("delta"))


def padded_tokens(spark, d):
    """Lengths of a text's words, cut or filled to 16 at either side."""
    lens = F.transform(F.filter(F.split("text", " "), lambda w: w != ""), F.length)
    row = table(spark, d, "conversations").select("conv_id", "turn", F.coalesce(lens, F.array().cast("array<int>")).alias("w"))
    text = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    return row.select("conv_id", "turn", text(padded(F.col("w"), 16)).alias("right_filled"), text(padded(F.col("w"), 16, left=True)).alias("left_filled"))


def shortened_urls(spark, d):
    p = table(spark, d, "pages")
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    return p.select("page_id", T.shortened(F.col("url"), 30, 27).alias("short"), F.when(host.endswith(".com"), F.concat(F.lit("https://com.example/?q="), host)).otherwise(F.concat(F.lit("https://other.example/"), host)).alias("link"))


QUERIES = {f.__name__: f for f in (tag_extract, requirement_after_marker, tool_event_parse, reward_mild, reward_capped, overlong_penalty, role_fix, tool_blocks, last_user_turn, role_validation, session_key_hash, props_json, tool_call_parse, running_best_delta, padded_tokens, shortened_urls)}

ORACLES = {
    "tag_extract": f"""WITH {WRAPPED}, a AS (SELECT *, CASE WHEN trim(regexp_extract(t, '(?is)<answer>\\s*(.+?)\\s*</answer>', 1)) <> '' THEN regexp_extract(t, '(?is)<answer>\\s*(.+?)\\s*</answer>', 1) END AS answer FROM w)
SELECT conv_id, turn, answer, contains(t, '<think>') AND contains(t, '</think>') AS has_think, contains(t, '<answer>') AND contains(t, '</answer>') AS has_answer, upper(regexp_replace(answer, '[^A-Za-z]', '', 'g')) AS answer_letters FROM a""",
    "requirement_after_marker": f"""WITH {WRAPPED}, a AS (SELECT *, list_extract(string_split(t, 'Task marker:'), -1) AS x FROM w)
SELECT conv_id, turn, trim(CASE WHEN contains(x, 'Stop here') THEN string_split(x, 'Stop here')[1] ELSE x END, ' ') AS requirement FROM a""",
    "tool_event_parse": f"""WITH {EVENTS} SELECT event_id, 0::BIGINT AS event, tool AS tool_name, true AS success, event_id % 7 AS num_scored, printf('%.3f', score)::DOUBLE AS best_round, printf('%.3f', score + 1)::DOUBLE AS global_best FROM e
UNION ALL SELECT event_id, 1, NULL, false, 0, NULL, NULL FROM e""",
    "reward_mild": f"""WITH {EVENTS}, g AS (SELECT user_id, sum(CASE WHEN success THEN 0.3::DOUBLE ELSE -0.1::DOUBLE END + CASE WHEN success AND score >= 15 THEN 0.3::DOUBLE WHEN success AND score >= 10 THEN 0.15::DOUBLE ELSE 0 END) AS r_tools,
 max(score) FILTER (success) AS best, count(*) AS n_events FROM e GROUP BY user_id)
SELECT user_id, round(r_tools, 6) AS r_tools, round(best, 6) AS best, n_events, round(r_tools + 0.5 * CASE WHEN best IS NULL THEN -0.2 ELSE greatest(0, least(best / 20, 1)) END - least(0.5, greatest(n_events - 6, 0) * 0.05), 6)::DOUBLE AS reward FROM g""",
    "reward_capped": f"""WITH {EVENTS}, c AS (SELECT *, (success AND tool = 'click')::INT AS earns, sum((success AND tool = 'click')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS nth FROM e),
g AS (SELECT user_id, sum(CASE WHEN earns = 1 AND nth <= 3 THEN 0.3::DOUBLE WHEN earns = 1 THEN 0 WHEN success THEN 0.1 ELSE -0.1 END) AS r_tools, max(score) FILTER (success) AS best, sum(earns)::BIGINT AS n_stage FROM c GROUP BY user_id)
SELECT user_id, round(r_tools, 6) AS r_tools, round(best, 6) AS best, n_stage, round(r_tools + 1.5 * CASE WHEN best IS NULL THEN -0.2 ELSE greatest(0, least(best / 20, 1)) END - CASE WHEN best IS NULL THEN 0.5 ELSE 0 END, 6)::DOUBLE AS reward FROM g""",
    "overlong_penalty": "SELECT doc_id, round(least(-(length(text) - 3072) / 1024.0::DOUBLE, 0.0::DOUBLE), 6) AS penalty FROM documents",
    "role_fix": """WITH x AS (SELECT *, lag(role = 'assistant' AND contains(coalesce(text, ''), 'the')) OVER (PARTITION BY conv_id ORDER BY turn) AS c FROM conversations)
SELECT conv_id, turn, CASE WHEN c AND role NOT IN ('assistant', 'tool') AND regexp_matches(coalesce(text, ''), '[.,]') THEN 'tool' ELSE role END AS fixed_role FROM x""",
    "tool_blocks": """WITH x AS (SELECT conv_id, turn, role = 'system' AS kind FROM conversations), y AS (SELECT *, CASE WHEN lag(kind) OVER w IS NOT DISTINCT FROM kind AND lag(1) OVER w IS NOT NULL THEN 0 ELSE 1 END AS n FROM x WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
z AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS b FROM y) SELECT conv_id, kind, min(turn) AS first, max(turn) AS last, count(*) AS n FROM z GROUP BY conv_id, kind, b""",
    "last_user_turn": "SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS text, arg_min(text, turn) AS first_text FROM conversations WHERE role = 'user' GROUP BY conv_id",
    "role_validation": "SELECT conv_id, count(*) AS n_turns, count(*) FILTER (coalesce(role = 'system' AND turn > 0 OR role NOT IN ('system', 'user', 'assistant', 'tool'), true)) AS n_bad, count(*) FILTER (role = 'assistant') AS n_assistant FROM conversations GROUP BY conv_id",
    "session_key_hash": """WITH x AS (SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN 'Session /' || conv_id ELSE 'req-' || left(sha256(coalesce(text, '')), 8) END AS session FROM conversations)
SELECT conv_id, turn, session, left(trim(lower(regexp_replace(session, '[^A-Za-z0-9._-]+', '-', 'g')), '-'), 64) || '-' || left(sha256(session), 8) AS folder FROM x""",
    "props_json": "SELECT event_id, " + ", ".join(f"CASE WHEN event_id % 3 < 2 THEN props->>'$.{f}' END AS f_{f}" for f in ("k", "session", "page", "a")) + ", length(props)::INT AS n FROM events",
    "tool_call_parse": "SELECT event_id, event_type AS name, event_id AS v FROM events",
    "running_best_delta": f"""WITH {EVENTS}, b AS (SELECT user_id, event_id, max(score) OVER (w ROWS UNBOUNDED PRECEDING) AS best, max(score) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_best FROM e WHERE success WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, round(best, 6) AS best, round(prev_best, 6) AS prev_best, round(CASE WHEN prev_best IS NULL THEN best ELSE best - prev_best END, 6) AS delta FROM b""",
    "padded_tokens": """WITH w AS (SELECT conv_id, turn, coalesce(list_transform(list_filter(string_split(text, ' '), lambda x: x <> ''), lambda x: length(x)), []) AS w FROM conversations),
z AS (SELECT *, list_transform(range(0, greatest(0, 16 - len(w))), lambda x: 0) AS f FROM w)
SELECT conv_id, turn, array_to_string(list_concat(w, f)[1:16], ',') AS right_filled, array_to_string(list_concat(f, w)[1:16], ',') AS left_filled FROM z""",
    "shortened_urls": """WITH p AS (SELECT *, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages)
SELECT page_id, CASE WHEN length(url) > 30 THEN left(url, 27) || '...' ELSE url END AS short, CASE WHEN host LIKE '%.com' THEN 'https://com.example/?q=' || host ELSE 'https://other.example/' || host END AS link FROM p""",
}
