"""Queries that build records: answers of dialogs, requirements, keywords, codes, flags."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ranking
from ..operators import trajectory as J
from ..sources.tables import table
from .trajectories import turns


def answer_table(spark, d):
    """Each dialog against the prompt of its number: requirement on both sides, ground truth (JSON, its single-quoted form or none), answer."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("idx"), T.letters(F.coalesce("text", F.lit(""))).alias("truth"))
    cell = F.when(F.col("idx") % 3 == 0, F.concat(F.lit('{"ground_truth": "'), F.col("truth"), F.lit('"}'))).when(F.col("idx") % 3 == 1, F.concat(F.lit("{'ground_truth': '"), F.col("truth"), F.lit("'}")))
    prompts = docs.select("idx", T.py_literal_field(cell, "ground_truth").alias("ground_truth"))
    said = J.last_turn(turns(spark, d), "conv_id", "turn", F.col("role") == "user").select(F.col("conv_id").alias("idx"), F.concat(F.lit("Design it. Requirement: "), F.col("text")).alias("asked"))
    last = J.last_turn(turns(spark, d), "conv_id", "turn", F.col("role") == "assistant").select(F.col("conv_id").alias("idx"), F.when(F.col("conv_id") % 4 != 0, F.concat(F.lit("<answer>"), F.col("text"), F.lit("</answer>"))).otherwise(F.col("text")).alias("said"))
    body = T.letters(T.tag_body(F.col("said"), "answer"))
    rows = said.join(prompts, "idx", "left").join(last, "idx", "left")
    return rows.select("idx", F.length(T.requirement(F.col("asked"), "requirement:")).alias("n_requirement"), F.md5(T.requirement(F.col("asked"), "requirement:")).alias("requirement"), "ground_truth", F.nullif(body, F.lit("")).alias("predicted"), F.coalesce(T.has_tag(F.col("said"), "answer"), F.lit(False)).cast("int").alias("has_tag"))


def requirement_lines(spark, d):
    """Numbered lines found again in texts whose first and last lines have no number."""
    lines = F.transform(F.split(F.translate(F.coalesce("text", F.lit("")), "0123456789.'\"]}", ""), "\n"), lambda x, i: F.concat(F.when(i > 0, F.concat(i.cast("string"), F.lit(". "))).otherwise(F.lit("")), x))
    text = F.concat(F.array_join(lines, "\n"), F.lit("\nThat is all, 'role': 'user'} ]"))
    row = table(spark, d, "documents").select("doc_id", text.alias("t"))
    block = T.numbered_block(F.col("t"))
    return row.select("doc_id", F.length(block).alias("n_block"), F.md5(block).alias("block"), F.md5(T.tail_stripped(F.col("t"))).alias("stripped"))


STOP = ["the", "and", "der", "die", "les", "que", "los", "with"]


def keyword_terms(spark, d):
    text = F.coalesce("text", F.lit(""))
    row = table(spark, d, "benchmark").select("item_id", text.alias("t"))
    parts, terms = T.keyword_parts(F.col("t")), T.query_tokens(F.col("t"), STOP)
    return row.select("item_id", F.size(parts).cast("long").alias("n_parts"), F.array_join(parts, "|").alias("parts"), F.array_join(terms, " ").alias("terms"), F.coalesce(T.contains_all(F.try_element_at(parts, F.lit(1)), terms), F.lit(False)).alias("has_all"))


def code_fields(spark, d):
    """Class numbers, lists of accessions, types and places written as text and read back."""
    p = table(spark, d, "part").select("p_partkey", "p_size", "p_brand", "p_type")
    n = lambda c: F.col(c).cast("string")
    text = F.concat(F.lit("EC "), n("p_size"), F.lit(".1, EC:"), n("p_partkey"), F.lit(".2.3.4 EC "), n("p_size"), F.lit(".1 EC x"))
    ec, acc = T.ec_numbers(text), T.accession_list(F.concat(n("p_brand"), F.lit(";; "), n("p_size"), F.lit(", "), n("p_partkey")))
    coded = F.concat(n("p_size"), F.element_at(F.array(*map(F.lit, (".1", ".1.-", ".x", ".2.3.4.5", "", ".4.5.6"))), (F.col("p_partkey") % 6 + 1).cast("int")))
    first, last = F.col("p_size") % 5 + 1, F.col("p_size") % 5 + 4
    return p.select("p_partkey", F.array_join(ec, "|").alias("ec"), T.is_ec(F.element_at(ec, 1)).alias("good_ec"), T.is_ec(coded).alias("code_ec"), F.array_join(acc, "|").alias("accessions"), F.upper(F.translate("p_type", " -", "")).alias("kind"), F.substring(F.col("p_type"), first, last - first + 1).alias("part"), F.format_string("%.2f%%", F.col("p_size") / 3.0).alias("share"))


def dialog_flags(spark, d):
    """Why each dialog stops (an answer, nothing asked, too many turns), and its prompt, written once however often it is built."""
    t = turns(spark, d).withColumn("text", F.coalesce("text", F.lit("")))
    g = t.groupBy("conv_id").agg(F.max("turn").alias("last"), F.max_by("role", "turn").alias("role"), F.min_by("text", "turn").alias("first"), F.count_if(F.col("role") == "assistant").alias("n_assistant"), F.max(T.flag(F.when(F.col("turn") % 2 == 0, F.col("turn").cast("string")).otherwise(F.col("role"))).cast("int")).alias("flag"))
    prompt = T.prefixed(T.prefixed(F.col("first"), "/think "), "/think ")
    built = F.when(F.trim("first") != "", F.concat_ws("\n\n", F.lit("Tools."), F.lit("Task:"), F.col("first")))
    return g.select("conv_id", (F.col("role") == "assistant").alias("answered"), (F.col("n_assistant") >= 4).alias("too_long"), "flag", F.md5(prompt).alias("prompt"), F.length(built).alias("n_built"))


def event_perplexity(spark, d):
    """exp of the negative mean of a given log-probability column, and at half the temperature, by user."""
    e = table(spark, d, "events").select("user_id", (-F.col("value") / 100).alias("logp"))
    return e.groupBy("user_id").agg(F.round(F.exp(-F.avg("logp")), 6).alias("perplexity"), F.round(F.exp(-F.avg(F.col("logp") / 0.5)), 6).alias("sharper"))


def first_filled_events(spark, d):
    """The first five events of each user that have a value, and a row that says that there are more."""
    e = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_id") % 3 != 0, F.round("value", 6)).alias("value")).filter("value is not null")
    top = ranking.top_k(e, ["user_id"], 6, "event_id")
    return top.select("user_id", F.when(F.col("rank") <= 5, F.col("event_id")).alias("event_id"), F.when(F.col("rank") <= 5, F.col("value")).alias("value"), F.when(F.col("rank") <= 5, F.lit("row")).otherwise(F.lit("more")).alias("kind"))


QUERIES = {f.__name__: f for f in (answer_table, requirement_lines, keyword_terms, code_fields, dialog_flags, event_perplexity, first_filled_events)}

ORACLES = {
    "answer_table": """WITH u AS (SELECT conv_id AS idx, arg_max(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id), a AS (SELECT conv_id AS idx, arg_max(text, turn) AS text FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
b AS (SELECT idx, text, CASE WHEN idx % 4 <> 0 THEN regexp_extract('<answer>' || text || '</answer>', '(?is)<answer>\\s*(.+?)\\s*</answer>', 1) END AS body FROM a),
r AS (SELECT idx, ' ' || text AS after, 'Design it. Requirement: ' || text AS whole FROM u),
k AS (SELECT idx, after, whole, list_filter(range(1, len(string_split(after, chr(10))) + 1), lambda i: regexp_matches(string_split(after, chr(10))[i], '\\d+\\.')) AS p FROM r),
s AS (SELECT idx, whole, regexp_replace(replace(regexp_replace(CASE WHEN len(p) > 0 THEN array_to_string(string_split(after, chr(10))[p[1]:p[-1]], chr(10)) ELSE after END, '(?is),\\s*[''"]role.*$', ''), '\\n', chr(10)), '[''"\\]\\}\\s]+$', '') AS t FROM k),
q AS (SELECT idx, coalesce(nullif(trim(t, ' '), ''), trim(regexp_replace(whole, '\\s+$', ''), ' ')) AS req FROM s),
d AS (SELECT doc_id AS idx, upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) AS truth FROM documents)
SELECT idx, length(req)::INT AS n_requirement, md5(req) AS requirement, CASE WHEN idx % 3 < 2 THEN truth END AS ground_truth, nullif(upper(regexp_replace(CASE WHEN trim(body) <> '' THEN body END, '[^A-Za-z]', '', 'g')), '') AS predicted, coalesce(idx % 4 <> 0 AND b.text IS NOT NULL OR contains(b.text, '<answer>') AND contains(b.text, '</answer>'), false)::INT AS has_tag
FROM q LEFT JOIN d USING (idx) LEFT JOIN b USING (idx)""",
    "requirement_lines": """WITH x AS (SELECT doc_id, string_split(translate(coalesce(text, ''), '0123456789.''"]}', ''), chr(10)) AS l FROM documents),
y AS (SELECT doc_id, list_transform(l, lambda v, i: CASE WHEN i > 1 THEN (i - 1) || '. ' ELSE '' END || v) AS l FROM x),
b AS (SELECT doc_id, l, CASE WHEN len(l) > 1 THEN array_to_string(l[2:], chr(10)) END AS b FROM y)
SELECT doc_id, length(b)::INT AS n_block, md5(b) AS block, md5(array_to_string(l, chr(10)) || chr(10) || 'That is all') AS stripped FROM b""",
    "keyword_terms": """WITH p AS (SELECT item_id, coalesce(text, '') AS t FROM benchmark), x AS (SELECT item_id, t, list_filter(list_concat(list_transform(regexp_split_to_array(t, '[,，;；]'), lambda v: trim(v, ' ')), [trim(t, ' ')]), lambda v: v <> '') AS parts, regexp_extract_all(t, '[A-Za-z0-9\\-()+./]+') AS f FROM p),
k AS (SELECT item_id, t, list_filter(parts, lambda v, i: list_position(list_transform(parts, lambda w: lower(w)), lower(v)) = i) AS parts, list_filter(f, lambda v, i: list_position(f, v) = i AND length(v) >= 3 AND lower(v) NOT IN ('the', 'and', 'der', 'die', 'les', 'que', 'los', 'with') AND NOT regexp_full_match(v, '[0-9]+')) AS f FROM x),
s AS (SELECT item_id, string_agg(v, ' ' ORDER BY NOT regexp_matches(v, '[\\-()+0-9A-Z]'), -length(v), i) AS terms FROM (SELECT item_id, unnest(f) AS v, unnest(range(1, len(f) + 1)) AS i FROM k) GROUP BY item_id)
SELECT item_id, len(parts) AS n_parts, array_to_string(parts, '|') AS parts, coalesce(terms, '') AS terms, coalesce(len(list_filter(f, lambda v: NOT contains(lower(parts[1]), lower(v)))) = 0, false) AS has_all FROM k LEFT JOIN s USING (item_id)""",
    "code_fields": """SELECT p_partkey, CASE WHEN p_size || '.1' = p_partkey || '.2.3.4' THEN p_size || '.1' ELSE p_size || '.1|' || p_partkey || '.2.3.4' END AS ec, true AS good_ec, p_partkey % 6 NOT IN (1, 2) AS code_ec, p_brand || '|' || p_size || '|' || p_partkey AS accessions,
 upper(replace(replace(p_type, ' ', ''), '-', '')) AS kind, substring(p_type, p_size % 5 + 1, 4) AS part, printf('%.2f%%', p_size / 3.0::DOUBLE) AS share FROM part""",
    "dialog_flags": """WITH g AS (SELECT conv_id, arg_max(role, turn) AS role, arg_min(coalesce(text, ''), turn) AS first, count(*) FILTER (role = 'assistant') AS n, max(CASE WHEN turn % 2 = 0 THEN (turn <> 0)::INT ELSE (role <> '')::INT END) AS flag FROM conversations GROUP BY conv_id)
SELECT conv_id, role = 'assistant' AS answered, n >= 4 AS too_long, flag, md5(CASE WHEN starts_with(ltrim(first, ' '), '/think ') THEN first ELSE '/think ' || first END) AS prompt, CASE WHEN trim(first, ' ') <> '' THEN length('Tools.' || chr(10) || chr(10) || 'Task:' || chr(10) || chr(10) || first) END::INT AS n_built FROM g""",
    "event_perplexity": "SELECT user_id, round(exp(-avg(-value / 100)), 6) AS perplexity, round(exp(-avg(-value / 100 / 0.5::DOUBLE)), 6) AS sharper FROM events GROUP BY user_id",
    "first_filled_events": """WITH r AS (SELECT user_id, event_id, round(value, 6) AS value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rank FROM events WHERE event_id % 3 <> 0 AND value IS NOT NULL)
SELECT user_id, CASE WHEN rank <= 5 THEN event_id END AS event_id, CASE WHEN rank <= 5 THEN value END AS value, CASE WHEN rank <= 5 THEN 'row' ELSE 'more' END AS kind FROM r WHERE rank <= 6""",
}
