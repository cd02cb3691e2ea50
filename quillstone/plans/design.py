"""Queries over design rules: constraints by class, patterns as letters, insertion points, violations, failed calls, masks for training, pointers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import design as D
from ..functions import entries as E
from ..functions import text as T
from ..operators import constraints as C
from ..operators import ranking
from ..sources.tables import table
from .evaluation import SEQ, sequences
from .trajectories import turns

CLASSES = [c for c, _ in E.COFACTOR_RULES] + ["auto", "auto_nad", "auto_atp_gtp", "auto_phosphate", "other"]


def cofactor_constraints(spark, d):
    """The rules of each document's class over its span (if it has one) or the whole of it."""
    n = F.length("seq")
    docs = sequences(spark, d).select("doc_id", n.alias("n"), F.element_at(F.array(*[F.lit(c) for c in CLASSES]), (F.col("doc_id") % len(CLASSES) + 1).cast("int")).alias("class"), (F.col("doc_id") % 5 + 1).cast("int").alias("a"))
    docs = docs.withColumn("b", F.when(F.col("doc_id") % 3 != 0, F.greatest("a", F.least("n", F.lit(60)))))
    rules = F.broadcast(spark.createDataFrame(D.RULES, D.RULE_COLUMNS))  # a fixed list
    rows = docs.join(rules, "class").filter((F.col("place") != "span") | F.col("b").isNotNull())
    where = lambda span, whole: F.when(F.col("place") == "span", span).when(F.col("place") == "whole", whole)
    value = F.when(F.col("divisor") > 0, F.greatest(F.lit(1), F.floor((F.col("b") - F.col("a") + 1) / F.col("divisor"))).cast("double")).otherwise(F.col("value"))
    return rows.select("doc_id", "class", "kind", "what", where(F.col("a"), F.lit(1)).alias("first"), where(F.col("b"), F.col("n")).alias("last"), value.alias("value"))


BANNED = ["YQ", "PAAP", "AAA"]


def pattern_letters(spark, d):
    """Patterns as a run of letters, wild patterns as real letters that break no rule, names as they are."""
    k = (F.col("p_size") % 4).cast("string")
    one = lambda m, *c: F.element_at(F.array(*c), (F.col("p_partkey") % m + 1).cast("int"))
    pattern = one(5, F.concat(F.lit("[KRH]{"), k, F.lit("}x.C")), F.concat(F.lit("A{"), k, F.lit("}[ST](G|P)")), F.concat(F.lit("^.{"), k, F.lit("}[^P]W$")), F.lit(""), F.lit("[DE]{20}K"))
    wild = one(5, F.lit("YXXL"), F.lit(" pxxp "), F.lit("aXXφ1"), F.lit("GxK"), F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", D.consensus(pattern).alias("letters"), D.instantiated(wild, BANNED).alias("instance"))


def insertion_points(spark, d):
    """Where a fragment costs least, outside locked runs; the costs come from a scorer's columns, here stated ones."""
    runs = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((10, 20), (30, 30))])
    cost = lambda a, m: lambda p: ((p * a + F.col("doc_id")) % m) / 10
    points = F.transform(C.candidate_points(F.length("seq"), 3, 8), lambda p: p + 1)
    best = sequences(spark, d).select("doc_id", D.insertion_point(points, runs, cost(37, 101), cost(53, 89)).alias("b"))
    return best.select("doc_id", F.col("b.before").cast("long").alias("before"), F.col("b.score").alias("score"))


def violation_picks(spark, d):
    """Of every third position, the fifth that violates the charge rules most; the first and last 20 letters are spans that may be worst."""
    s, n = F.col("seq"), F.length("seq")
    count = lambda t, w: F.length(t) - F.length(F.translate(t, w, ""))
    head, tail = F.left(s, F.lit(20)), F.right(s, F.lit(20))
    span = lambda bad, a, b: F.when(bad, F.array(F.struct(a.alias("start"), b.alias("end"))))
    worst = F.flatten(F.filter(F.array(span(count(head, "DE") < 3, F.lit(1), F.lit(20)), span(count(tail, "KRH") - count(tail, "DE") > 2, n - 19, n + 0)), lambda x: x.isNotNull()))
    letters = F.regexp_extract_all(s, F.lit("(.).{0,2}"), F.lit(1))
    rows = sequences(spark, d).select("doc_id", letters.alias("c"), worst.alias("w")).withColumn("p", F.transform("c", lambda x, i: i * 3 + 1))
    picked = D.most_violating(F.col("c"), F.col("p"), F.col("w"), 0.2)
    return rows.select("doc_id", picked.alias("x")).select("doc_id", F.size("x").cast("long").alias("n"), F.md5(F.array_join(F.transform("x", lambda p: p.cast("string")), ",")).alias("picked"))


TOOLS = [*D.SCAFFOLD_TOOLS, *D.CONSTRAINT_TOOLS, "esm_inpaint"]


def failed_calls(spark, d):
    """What is told of events as failed calls of tools."""
    e, i = table(spark, d, "events"), F.col("event_id")
    tool = F.element_at(F.array(*[F.lit(t) for t in TOOLS]), (i % len(TOOLS) + 1).cast("int"))
    argument = F.when(i % 4 != 0, F.concat(F.lit(" "), F.repeat(F.col("event_type"), (i % 30).cast("int") + 1)))
    text = D.failed_call(tool, i % 7, argument, F.when(i % 5 != 0, F.floor("value") / 8), F.when(i % 3 != 0, F.concat(F.lit("A"), F.col("user_id").cast("string"))).otherwise(F.lit("")))
    return e.select("event_id", text.alias("t")).select("event_id", F.length("t").alias("n"), F.md5("t").alias("told"))


VOCABULARY = ["ka", "lo", "mi", "nu", "pe"]


def masked_training(spark, d):
    """Turns with 15 in 100 tokens chosen: most masked, some drawn anew, some kept."""
    t = turns(spark, d).select("conv_id", "turn", T.tokens(F.coalesce("text", F.lit(""))).alias("k"))
    key = F.concat_ws("|", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    m = t.withColumn("m", D.training_mask(F.col("k"), key, 7, 0.15, "<mask>", VOCABULARY))
    return m.select("conv_id", "turn", F.size(F.filter("m", lambda x: x["chosen"])).cast("long").alias("n_chosen"), F.md5(F.array_join(F.transform("m", lambda x: x["token"]), " ")).alias("tokens"))


def loss_masks(spark, d):
    """Dialogs as tokens cut and padded to 256, with a mask of what the assistant says."""
    t = turns(spark, d).select("conv_id", F.struct("turn", "role", T.tokens(F.coalesce("text", F.lit(""))).alias("tokens")).alias("t"))
    g = t.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))  # one dialog
    m = D.loss_mask(F.col("turns"), 256)
    return g.select("conv_id", m["n_tokens"].cast("long").alias("n_tokens"), F.md5(F.array_join(m["tokens"], " ")).alias("tokens"), F.array_join(F.transform(m["mask"], lambda x: x.cast("string")), "").alias("mask"))


def motif_defaults(spark, d):
    """Motifs written as one, as a list, or not at all, with all fields; fields that may be broken; identifiers as links."""
    one = lambda m, *c: F.element_at(F.array(*c), (F.col("p_partkey") % m + 1).cast("int"))
    s = F.col("p_size").cast("string")
    json = one(5, F.lit(None).cast("string"), F.lit("{}"), F.concat(F.lit('{"sequence":"ACX","flank_k":'), s, F.lit("}")), F.concat(F.lit('[{"alpha":2.5},{"sequence":"W","left_linker":"GS","forbid_overlap_locked":false,"beta":'), s, F.lit("}]")), F.lit("[]"))
    listed = F.transform(D.motif_list(json), lambda m: F.concat_ws(";", m["sequence"], m["left_linker"], m["right_linker"], m["flank_k"].cast("string"), F.format_string("%.2f", m["alpha"]), F.format_string("%.2f", m["beta"]), m["forbid_overlap_locked"].cast("string")))
    tools = one(6, F.lit("NaN"), F.lit(" none "), F.lit('{"a":'), F.concat(F.lit("[1,"), s, F.lit("]")), F.lit("null"), F.lit(None).cast("string"))
    link = D.id_link(F.concat(F.lit("1abc-"), s), one(5, F.lit("Swiss-Prot"), F.lit("PDB"), F.lit("NCBI"), F.lit("GOPC"), F.lit("Baker's yeast")))
    return table(spark, d, "part").select("p_partkey", F.array_join(listed, "|").alias("motifs"), D.restored(tools).alias("tools"), link.alias("link"))


def pointer_lookup(spark, d):
    """Pointers "subsection|place" of a whole list, followed into the subsections' own rows."""
    o = table(spark, d, "orders").select("o_orderkey", F.concat_ws("|", F.col("o_orderkey").cast("string"), (F.col("o_orderkey") % 4 + 1).cast("string")).alias("pointer"))
    part = F.split("pointer", r"\|")
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sub"), F.col("l_linenumber").alias("place"), "l_partkey", "l_suppkey", "l_quantity")
    return o.withColumns({"sub": part[0].cast("long"), "place": part[1].cast("int")}).join(lines, ["sub", "place"], "left").select("o_orderkey", "pointer", "l_partkey", "l_suppkey", "l_quantity")


def masked_accuracy(spark, d):
    """Right guesses over all guesses, of rows that are not masked out, by language."""
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id").filter("toxic = 0")
    right = (F.col("n_chars") >= 400) == (F.col("quality") == 1)
    return rows.groupBy("lang").agg(F.sum(right.cast("long")).alias("n_right"), F.count("*").alias("n"), F.round(F.sum(right.cast("long")) / F.count("*"), 6).alias("accuracy"))


def source_samples(spark, d):
    """The first three documents of each source, to look at."""
    docs = table(spark, d, "documents").select("source", "doc_id", F.col("text").alias("shown"))
    return ranking.top_k(docs, ["source"], 3, "doc_id").select("source", "doc_id", "shown", F.col("rank").cast("long").alias("rank"))


QUERIES = {f.__name__: f for f in (cofactor_constraints, pattern_letters, insertion_points, violation_picks, failed_calls, masked_training, loss_masks, motif_defaults, pointer_lookup, masked_accuracy, source_samples)}


def _told():
    keys = D.SCAFFOLD_TOOLS | D.CONSTRAINT_TOOLS
    kind = {t: "scaffold" for t in D.SCAFFOLD_TOOLS} | {t: "constraint" for t in D.CONSTRAINT_TOOLS}
    quote = lambda text: "'" + text.replace("'", "''").replace("{r}", "' || r || '").replace("{v}", "' || v || '") + "'"
    out = ""
    for t in TOOLS:
        with_, without = (x.replace("{t}", t).replace("{k}", keys.get(t) or "") for x in D.FAILED[kind.get(t, "other")])
        out += f" WHEN t = '{t}' THEN " + (f"CASE WHEN v IS NOT NULL THEN {quote(with_)} ELSE {quote(without)} END" if keys.get(t) else quote(without))
    return f"CASE{out} END"


_RULES = ", ".join(f"('{c}', '{k}', '{p}', '{w}', {v}::DOUBLE, {n})" for c, k, p, w, v, n in D.RULES)
_NAMES = ", ".join(f"'{c}'" for c in CLASSES)
_KEYS = " ".join(f"WHEN '{t}' THEN '{k}'" for t, k in (D.SCAFFOLD_TOOLS | D.CONSTRAINT_TOOLS).items() if k)
_U = "('0x' || left(md5(conv_id || '|' || turn || '|' || (i - 1) || '|{}'), 8))::BIGINT / 4294967296.0::DOUBLE"
ORACLES = {
    "cofactor_constraints": f"""WITH r(class, kind, place, what, value, divisor) AS (VALUES {_RULES}), q AS (SELECT doc_id, length({SEQ}) AS n, [{_NAMES}][doc_id % {len(CLASSES)} + 1] AS class, doc_id % 5 + 1 AS a FROM documents),
s AS (SELECT *, CASE WHEN doc_id % 3 <> 0 THEN greatest(a, least(n, 60)) END AS b FROM q)
SELECT doc_id, class, kind, what, CASE place WHEN 'span' THEN a WHEN 'whole' THEN 1 END::INT AS first, CASE place WHEN 'span' THEN b WHEN 'whole' THEN n END::INT AS last, CASE WHEN divisor > 0 THEN greatest(1, (b - a + 1) // divisor)::DOUBLE ELSE value END AS value FROM s JOIN r USING (class) WHERE place <> 'span' OR b IS NOT NULL""",
    "pattern_letters": """WITH p AS (SELECT *, regexp_replace(upper(p_name), '[^ACDEFGHIKLMNPQRSTVWY]', 'A', 'g') AS s FROM part), c AS (SELECT p_partkey, s, unnest(range(1, length(s) + 1)) AS i, unnest(string_split(s, '')) AS c FROM p WHERE regexp_matches(s, 'YQ|PAAP|AAA')),
t AS (SELECT p_partkey, i, k, s[1:i - 1] || ['Q', 'N', 'S', 'T', 'G'][k] || s[i + 1:] AS t FROM c, range(1, 6) r(k) WHERE c = 'A'), b AS (SELECT p_partkey, arg_min(t, i * 10 + k) AS t FROM t WHERE NOT regexp_matches(t, 'YQ|PAAP|AAA') GROUP BY p_partkey)
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN repeat('K', p_size % 4) || 'XXC' WHEN 1 THEN repeat('A', p_size % 4) || 'SGP' WHEN 2 THEN repeat('X', p_size % 4) || '[P]W' WHEN 3 THEN 'XXX' ELSE 'DDDDDDDDDDDD' END AS letters,
CASE p_partkey % 5 WHEN 0 THEN 'YNRL' WHEN 1 THEN 'PTPP' WHEN 2 THEN 'QAALA' WHEN 3 THEN 'GAK' ELSE coalesce(t, s) END AS instance FROM p LEFT JOIN b USING (p_partkey)""",
    "insertion_points": f"""WITH q AS (SELECT doc_id, length({SEQ}) AS n FROM documents), p AS (SELECT DISTINCT doc_id, 1 + least(greatest(round_even(n * (k // 8) / 3.0::DOUBLE + (n * (k // 8 + 1) / 3.0::DOUBLE - n * (k // 8) / 3.0::DOUBLE) * (k % 8) / 7, 0)::INT, 0), n) AS p FROM q, range(24) t(k)),
s AS (SELECT doc_id, p AS before, round((p * 37 + doc_id) % 101 / 10.0::DOUBLE + 0.25::DOUBLE * ((p * 53 + doc_id) % 89 / 10.0::DOUBLE), 6) AS score FROM p WHERE NOT (p > 10 AND p <= 20))
SELECT doc_id, before::BIGINT AS before, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score, before) AS rn FROM s) WHERE rn = 1""",
    "violation_picks": f"""WITH q AS (SELECT doc_id, {SEQ} AS s FROM documents), w AS (SELECT *, length(s) AS n, length(left(s, 20)) - length(translate(left(s, 20), 'DE', '')) < 3 AS h, length(translate(right(s, 20), 'DE', '')) - length(translate(right(s, 20), 'KRH', '')) > 2 AS t FROM q),
l AS (SELECT doc_id, n, h, t, unnest(range(1, n + 1)) AS p, unnest(string_split(s, '')) AS c FROM w WHERE n > 0), g AS (SELECT doc_id, p, CASE WHEN c IN ('K', 'R', 'H') THEN 2 ELSE 0 END + CASE WHEN c IN ('D', 'E') THEN 0 ELSE 1 END + CASE WHEN h AND p <= 20 OR t AND p >= n - 19 THEN 1 ELSE 0 END AS score FROM l WHERE p % 3 = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, p DESC) AS rn, count(*) OVER (PARTITION BY doc_id) AS m FROM g), x AS (SELECT doc_id, count(*) AS n, string_agg(p, ',' ORDER BY rn) AS picked FROM k WHERE rn <= greatest(1, floor(m * 0.2::DOUBLE)) GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n, md5(coalesce(picked, '')) AS picked FROM q LEFT JOIN x USING (doc_id)""",
    "failed_calls": f"""WITH e AS (SELECT event_id, [{", ".join(f"'{t}'" for t in TOOLS)}][event_id % {len(TOOLS)} + 1] AS t, event_id % 7 AS r, CASE WHEN event_id % 4 <> 0 THEN repeat(event_type, (event_id % 30 + 1)::INT) END AS a, CASE WHEN event_id % 5 <> 0 THEN printf('%.3f', floor(value) / 8) END AS b, CASE WHEN event_id % 3 <> 0 THEN 'A' || user_id END AS acc FROM events),
k AS (SELECT *, CASE t {_KEYS} END AS k FROM e), v AS (SELECT *, CASE WHEN k IS NOT NULL THEN CASE WHEN length(a) > 120 THEN left(a, 117) || '...' ELSE a END END AS v FROM k),
o AS (SELECT event_id, concat_ws(chr(10), {_told()} || coalesce(' Global best ProTrek remains ' || b || '.', ''), 'Summary:', '- round: ' || r, '- tool: ' || t, '- num_sequences_scored: 0', '- global_best_ProTrek: ' || b, '- prev_global_best_ProTrek: ' || b, '- delta_best: +0.000', '- argument_' || k || ': ' || v, '- current_best_accession: ' || acc) AS o FROM v)
SELECT event_id, length(o)::INT AS n, md5(o) AS told FROM o""",
    "masked_training": f"""WITH t AS (SELECT conv_id, turn, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_-]+') AS k FROM conversations), u AS (SELECT conv_id, turn, unnest(k) AS w, unnest(range(1, len(k) + 1)) AS i FROM t),
x AS (SELECT *, {_U.format(7)} AS u, {_U.format(8)} AS v FROM u), y AS (SELECT conv_id, turn, count(*) FILTER (u < 0.15::DOUBLE) AS n, string_agg(CASE WHEN u < 0.15::DOUBLE * 0.8::DOUBLE THEN '<mask>' WHEN u >= 0.15::DOUBLE * 0.8::DOUBLE AND u < 0.15::DOUBLE * 0.9::DOUBLE THEN ['ka', 'lo', 'mi', 'nu', 'pe'][floor(v * 5)::INT + 1] ELSE w END, ' ' ORDER BY i) AS s FROM x GROUP BY ALL)
SELECT conv_id, turn, coalesce(n, 0) AS n_chosen, md5(coalesce(s, '')) AS tokens FROM t LEFT JOIN y USING (conv_id, turn)""",
    "loss_masks": """WITH t AS (SELECT conv_id, turn, role, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_-]+') AS k FROM conversations),
g AS (SELECT conv_id, flatten(list(list_concat(['<' || role || '>'], k, ['<end>']) ORDER BY turn)) AS w, string_agg('0' || repeat((role = 'assistant')::INT::VARCHAR, len(k) + 1), '' ORDER BY turn) AS m FROM t GROUP BY conv_id)
SELECT conv_id, len(w) AS n_tokens, md5(array_to_string(list_transform(range(1, 257), lambda i: coalesce(w[i], '<pad>')), ' ')) AS tokens, rpad(left(m, 256), 256, '0') AS mask FROM g""",
    "motif_defaults": """SELECT p_partkey, CASE p_partkey % 5 WHEN 1 THEN ';;;8;1.00;0.25;true' WHEN 2 THEN 'ACX;;;' || p_size || ';1.00;0.25;true' WHEN 3 THEN ';;;8;2.50;0.25;true|W;GS;;8;1.00;' || p_size || '.00;false' ELSE '' END AS motifs, CASE WHEN p_partkey % 6 = 3 THEN '[1,' || p_size || ']' END AS tools,
'[1abc-' || p_size || '](https://www.' AS x, CASE p_partkey % 5 WHEN 1 THEN x || 'rcsb.org/structure/1abc)' WHEN 2 THEN x || 'ncbi.nlm.nih.gov/protein/1abc-' || p_size || ')' WHEN 3 THEN '1abc-' || p_size ELSE x || 'uniprot.org/uniprotkb/1abc-' || p_size || ')' END AS link FROM part""",
    "pointer_lookup": "SELECT o_orderkey, o_orderkey || '|' || (o_orderkey % 4 + 1) AS pointer, l_partkey, l_suppkey, l_quantity FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = o_orderkey % 4 + 1",
    "masked_accuracy": "SELECT lang, count(*) FILTER ((n_chars >= 400) = (quality = 1)) AS n_right, count(*) AS n, round(count(*) FILTER ((n_chars >= 400) = (quality = 1)) / count(*), 6) AS accuracy FROM labels JOIN documents USING (doc_id) WHERE toxic = 0 GROUP BY lang",
    "source_samples": "SELECT source, doc_id, text AS shown, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents) WHERE rank <= 3",
}
ORACLES["motif_defaults"] = f"SELECT p_partkey, motifs, tools, link FROM ({ORACLES['motif_defaults']})"
