"""Queries over rules on sequences: signals, patterns, masks, session rounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import design as D
from ..functions import entries as E
from ..functions import seq as S
from ..functions import text as T
from ..operators import constraints as C
from ..operators import ranking, sessions
from ..operators import sequences as Q
from ..sources.tables import table
from .evaluation import SEQ, sequences
from .trajectories import EVENTS, event_rows


def signal_choice(spark, d):
    """The signal of the least penalty for each document's host (its language, mapped to one) and first letter, and the sequence behind it."""
    host = F.coalesce(F.create_map(*[F.lit(x) for x in ("en", "bacteria", "de", "yeast", "fr", "mammal")])[F.col("lang")], F.lit("bacteria"))
    docs = table(spark, d, "documents").select("doc_id", T.letters(F.coalesce("text", F.lit(""))).alias("seq"), host.alias("host"))
    one = lambda i, x: F.struct((C.signal_penalty(F.lit(x[2]), F.col("host") != x[1], F.col("seq"))).alias("penalty"), (F.col("host") != x[1]).alias("other"), F.lit(i).alias("place"), F.lit(x[0]).alias("name"), F.lit(x[2]).alias("signal"))
    best = docs.withColumn("b", F.array_min(F.array(*[one(i, x) for i, x in enumerate(C.SIGNALS)])))
    whole = C.with_signal(F.col("b.signal"), F.col("seq"))
    return best.select("doc_id", F.col("b.name").alias("name"), F.col("b.penalty").cast("long").alias("penalty"), C.cleavage_fixed(F.col("b.signal")).alias("fixed"), F.md5(whole).alias("whole"))


PATTERNS = ["N-{P}-[ST]-{P}.", "T-H-x(2,3)-R.", "<[AT]-x(2)-E.", "C-x-x-C.", "[RK](2)-x-[DE]."]


def pattern_scan(spark, d):
    """All places of five patterns in each sequence, as counts and as the first and last place."""
    regex = [r[0] for r in spark.createDataFrame([(p,) for p in PATTERNS], "p string").select(S.pattern_to_regex(F.col("p"))).collect()]  # the stated patterns
    s = sequences(spark, d).select("doc_id", F.explode(Q.pattern_spans(F.col("seq"), [*regex, "(bad"])).alias("x"))
    return s.groupBy("doc_id", F.col("x.pattern").alias("pattern")).agg(F.count("*").alias("n"), F.min("x.s").cast("long").alias("first"), F.max("x.e").cast("long").alias("last"))


#: A catalogue of motifs as a user's table would have it: pattern and description.
MOTIFS = [("N[^P][ST][^P]", "Asn linked site"), ("C..C", "zinc finger"), ("[RK]{2}.[DE]", "ATP or GTP site, P-loop"), ("TH.{2,3}R", "phosphate loop"), ("A[ST]{2,3}", "NADP fold"), ("[ILV]{3,}", "membrane stretch")]
#: Which exemplars' weak rules a class of motif descriptions takes; other classes have none.
EXEMPLARS = {"nad": "auto_nad", "flavin": "auto_nad", "atp_gtp": "auto_atp_gtp"}


def motif_scan_rules(spark, d):
    """Rules from the motifs found in each sequence: the five longest hits name the class and the patterns to keep; the class's
    exemplars bound letters, charge and hydropathy in windows of 16 letters around the first three, and hydropathy in the whole."""
    s = sequences(spark, d).select("doc_id", "seq", F.length("seq").alias("n"))
    told = F.array(*[F.lit(t) for _, t in MOTIFS])
    hits = s.select("doc_id", "n", Q.longest_spans(Q.pattern_spans(F.col("seq"), [p for p, _ in MOTIFS])).alias("hits"))
    text = F.concat_ws(" ", F.transform("hits", lambda x: F.element_at(told, x["i"] + 1)))
    hits = hits.select("doc_id", "n", E.first_class(text, E.PATTERN_TEXT_RULES, "unknown").alias("class"), Q.widened(F.slice("hits", 1, 3), F.col("n"), 16).alias("windows"), F.array_distinct(F.transform("hits", lambda x: x["pattern"])).alias("kept"))
    weak = [F.array(*[F.struct(*[F.lit(x).alias(c) for x, c in zip(r[1:], ("kind", "place", "what", "value", "divisor"))]) for r in D.RULES if r[0] == auto and r[2] != "any"]) for auto in EXEMPLARS.values()]
    rules = F.coalesce(*[F.when(F.col("class") == c, w) for c, w in zip(EXEMPLARS, weak)], F.slice(weak[0], 1, 0))
    whole = F.array(F.struct(F.lit(1).alias("first"), F.col("n").alias("last")))
    row = lambda kind, what, nth, first, last, value: F.struct(kind.alias("kind"), what.alias("what"), nth.alias("nth"), first.alias("first"), last.alias("last"), value.alias("value"))

    def bound(r):
        value = lambda w: F.when(r["divisor"] > 0, F.greatest(F.lit(1), F.floor((w["last"] - w["first"] + 1) / r["divisor"])).cast("double")).otherwise(r["value"])
        return F.transform(F.when(r["place"] == "span", F.col("windows")).otherwise(whole), lambda w, i: row(r["kind"], r["what"], i, w["first"], w["last"], value(w)))

    none = F.lit(None).cast("int")
    kept = F.transform("kept", lambda p: row(F.lit("regex_allow"), p, none, none, none, F.lit(None).cast("double")))
    return hits.select("doc_id", "class", F.explode(F.concat(F.flatten(F.transform(rules, bound)), kept)).alias("x")).select("doc_id", "class", "x.*")


#: Another such catalogue, told in the four languages of the texts.
TOLD = [("C.{2}C", "zinc finger for this ring"), ("[RK]{2}G[ST]", "P-loop that binds with ATP"), ("GAGAAG", "NADPH fold, nicht sich mit"), ("HA{2}H", "heme site, avec dans les"), ("K[ST]{2}", "PLP site, para una con"), ("[DE]{3}", "calcium ring from this")]
#: Letters whose share in a class's sequences bounds new ones.
SHARES = {"kr": "KR", "g": "G", "de": "DE"}


def class_exemplars(spark, d):
    """Each class of motifs that texts ask for, with the shares of letters in the sequences of its texts."""
    return Q.exemplars(asked(spark, d), "class", "seq", SHARES)


def asked(spark, d):
    """The texts that ask for motifs, with up to three of them, the class that these name, and the sequence."""
    docs = table(spark, d, "documents").select("doc_id", "text", T.letters(F.coalesce("text", F.lit(""))).alias("seq"))
    # As a filter, the search would be pushed below its own result and run twice.
    hits = docs.select("doc_id", "seq", F.explode(F.filter(F.array(Q.text_hits(F.col("text"), TOLD)), lambda h: F.size(h) > 0)).alias("hits"))
    return hits.withColumn("class", E.first_class(F.concat_ws(" ", F.transform("hits", lambda x: x["told"])), E.PATTERN_TEXT_RULES, "unknown"))


def text_motif_rules(spark, d):
    """Rules from the motifs that a text asks for, found or not: patterns to allow, a motif of the first one, and as many letters
    as the class's exemplars have in as long a sequence."""
    rows = asked(spark, d)
    stats = F.broadcast(Q.exemplars(rows, "class", "seq", SHARES))  # a row for each of the stated classes
    least = lambda c: F.greatest(F.lit(1), F.floor(F.length("seq") * F.coalesce(F.col(c), F.lit(0.0)))).cast("long").alias(f"least_{c}")
    allow = F.array_join(F.array_distinct(F.transform("hits", lambda x: x["pattern"])), " ")
    scores = F.array_join(F.transform("hits", lambda x: x["score"].cast("string")), ",")
    return rows.join(stats, "class").select("doc_id", "class", allow.alias("regex_allow"), scores.alias("scores"), D.consensus(F.col("hits")[0]["pattern"]).alias("motif"), *[least(c) for c in SHARES])


def pattern_counts(spark, d):
    """The same counts without leaving the JVM."""
    s = sequences(spark, d).withColumn("pattern", F.explode(F.array(*[S.pattern_to_regex(F.lit(p)) for p in PATTERNS])))
    n = F.size(F.regexp_extract_all(F.col("seq"), F.col("pattern"), F.lit(0)))
    return s.select("doc_id", "pattern", n.cast("long").alias("n")).filter("n > 0")


def mask_windows(spark, d):
    s = F.col("seq")
    spans = F.array(*[F.struct(F.lit(a).cast("long").alias("s"), F.lit(b).cast("long").alias("e")) for a, b in ((5, 9), (14, 20), (60, 70))])
    locked = F.array(*[F.lit(x).cast("long") for x in (6, 7, 64)])
    m = sequences(spark, d).select("doc_id", C.mask_positions(F.length(s), spans, 3, locked).alias("m"))
    return m.select("doc_id", F.array_join(F.transform("m", lambda x: x.cast("string")), ",").alias("masked"))


def blocked_points(spark, d):
    s = sequences(spark, d).withColumn("n", F.length("seq"))
    blocked = C.blocked_positions(F.col("n"), 2, 9, F.array(F.lit(0), F.lit(10)))
    points = C.candidate_points(F.col("n"), 3, 8)
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda t, x: t + x)
    return s.select("doc_id", F.size(blocked).cast("long").alias("n_blocked"), total(blocked).alias("sum_blocked"), F.size(points).cast("long").alias("n_points"), total(points).alias("sum_points"))


def session_rounds(spark, d):
    """Scored candidates by session and round: new ones, the best of the round and so far, the improvement."""
    e = event_rows(spark, d).filter("success").select(F.col("user_id").alias("session"), F.floor(F.col("event_id") / 500).alias("round"), F.concat(F.col("tool"), F.lit("-"), (F.col("event_id") % 17).cast("string")).alias("candidate"), "score")
    r = sessions.rounds(e)
    return r.select("session", "round", "n_new", F.round("best_round", 6).alias("best_round"), F.round("best", 6).alias("best"), F.round("delta", 6).alias("delta"))


def stream_session_topk(spark, d):
    """The best three of every session, from a stream over the same rows and a batch twin in tests."""
    from ..streaming.sessions import best_of_stream

    return best_of_stream(spark, f"{d}/events.parquet", k=3)


QUERIES = {f.__name__: f for f in (signal_choice, pattern_scan, motif_scan_rules, text_motif_rules, class_exemplars, pattern_counts, mask_windows, blocked_points, session_rounds, stream_session_topk)}

SIGNAL_ROWS = ", ".join(f"({i}, '{n}', '{h}', '{s}')" for i, (n, h, s) in enumerate(C.SIGNALS))
_MOTIFS = ", ".join(f"({i}, '{p}', '{t}')" for i, (p, t) in enumerate(MOTIFS))
_SCANS = " UNION ALL ".join(f"SELECT doc_id, s, {i} AS i, regexp_extract_all(s, '{p}') AS m, regexp_split_to_array(s, '{p}') AS g FROM q" for i, (p, _) in enumerate(MOTIFS))
_CLASS = "CASE " + " ".join(f"WHEN regexp_matches(text, '{r}') THEN '{c}'" for c, r in E.PATTERN_TEXT_RULES) + " ELSE 'unknown' END"
_WEAK = ", ".join(f"('{c}', '{k}', '{p}', '{w}', {v}::DOUBLE, {n})" for c, k, p, w, v, n in D.RULES if c.startswith("auto_") and p != "any")
_TOLD = ", ".join(f"({i}, '{p}', '{t}')" for i, (p, t) in enumerate(TOLD))
_ASKED = f"""t AS (SELECT doc_id, {SEQ} AS s, lower(trim(coalesce(text, ''))) AS low FROM documents), w AS (SELECT *, regexp_extract_all(low, '[a-z0-9]+') AS w FROM t), p(i, pattern, told) AS (VALUES {_TOLD}),
x AS (SELECT doc_id, s, i, pattern, told, CASE WHEN contains(lower(told), low) THEN 5 ELSE 0 END + len(list_filter(w, lambda v: list_contains(regexp_extract_all(lower(told), '[a-z0-9]+'), v))) AS score FROM w, p),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) AS r FROM x WHERE score > 0), h AS (SELECT doc_id, any_value(s) AS s, lower(string_agg(told, ' ' ORDER BY r)) AS text, string_agg(pattern, ' ' ORDER BY r) AS regex_allow, string_agg(score::BIGINT, ',' ORDER BY r) AS scores, min(i) FILTER (r = 1) AS first FROM r WHERE r <= 3 GROUP BY doc_id),
k AS (SELECT *, {_CLASS} AS class FROM h), e AS (SELECT class, count(*) AS n, {", ".join(f"round(sum(length(s) - length(translate(s, '{x}', ''))) / nullif(sum(length(s)), 0), 6) AS {c}" for c, x in SHARES.items())} FROM k GROUP BY class)"""
#: The motifs' consensus, written out.
_LETTERS = ["CXXC", "RRGS", "GAGAAG", "HAAH", "KSS", "DDD"]
ORACLES = {
    "class_exemplars": f"WITH {_ASKED} SELECT * FROM e",
    "text_motif_rules": f"""WITH {_ASKED} SELECT doc_id, class, regex_allow, scores, {_LETTERS}[first + 1] AS motif, {", ".join(f"greatest(1, floor(length(s) * coalesce({c}, 0)))::BIGINT AS least_{c}" for c in SHARES)} FROM k JOIN e USING (class)""",
    "motif_scan_rules": f"""WITH q AS (SELECT doc_id, {SEQ} AS s FROM documents), p(i, pattern, told) AS (VALUES {_MOTIFS}), x AS ({_SCANS}),
l AS (SELECT doc_id, s, i, unnest(range(1, len(m) + 1)) AS k, unnest(m) AS m, unnest(g[1:len(m)]) AS g FROM x),
h AS (SELECT doc_id, length(s) AS n, i, length(m) AS w, sum(length(g) + length(m)) OVER (PARTITION BY doc_id, i ORDER BY k) AS e FROM l),
t AS (SELECT *, e - w AS b, row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, i, e) AS r FROM h),
f AS (SELECT doc_id, n, r - 1 AS nth, pattern, told, greatest(16, w) AS wide, greatest(1, (b + 1 + e) // 2 - greatest(16, w) // 2) AS first FROM t JOIN p USING (i) WHERE r <= 5),
c AS (SELECT doc_id, any_value(n) AS n, lower(string_agg(told, ' ' ORDER BY nth)) AS text FROM f GROUP BY doc_id), k AS (SELECT doc_id, n, {_CLASS} AS class FROM c),
a AS (SELECT *, CASE WHEN class IN ('nad', 'flavin') THEN 'auto_nad' WHEN class = 'atp_gtp' THEN 'auto_atp_gtp' END AS auto FROM k), rule(auto, kind, place, what, value, divisor) AS (VALUES {_WEAK}),
s AS (SELECT doc_id, class, auto, 'span' AS place, nth, first, least(a.n, first + wide - 1) AS last FROM a JOIN f USING (doc_id) WHERE nth < 3 UNION ALL SELECT doc_id, class, auto, 'whole', 0, 1, n FROM a)
SELECT doc_id, class, kind, what, nth::INT AS nth, first::INT AS first, last::INT AS last, CASE WHEN divisor > 0 THEN greatest(1, (last - first + 1) // divisor)::DOUBLE ELSE value END AS value FROM s JOIN rule USING (auto, place)
UNION ALL SELECT DISTINCT doc_id, class, 'regex_allow', pattern, NULL, NULL, NULL, NULL FROM a JOIN f USING (doc_id)""",
    "signal_choice": f"""WITH s(place, name, host, g) AS (VALUES {SIGNAL_ROWS}), d AS (SELECT doc_id, {SEQ} AS t, CASE lang WHEN 'de' THEN 'yeast' WHEN 'fr' THEN 'mammal' ELSE 'bacteria' END AS host FROM documents),
p AS (SELECT doc_id, t, name, place, g, s.host <> d.host AS other, (s.host <> d.host)::INT + CASE WHEN regexp_matches(right(g, 3), '^[ASGTV].[ASGTV]$') THEN 0 ELSE 2 END + length(right(g, 6)) - length(translate(right(g, 6), 'DEKRHP', '')) + (t[1:1] IN ('D', 'E'))::INT + (length(g) < 15 OR length(g) > 30)::INT AS penalty FROM d, s),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY penalty, other, place) AS rn, translate(right(g, 6), 'DEKRHP', 'AAAAAA') AS x FROM p),
f AS (SELECT *, g[1:length(g) - 6] || x[1:3] || CASE WHEN contains('ASGTV', x[4]) THEN x[4] ELSE 'A' END || x[5] || CASE WHEN contains('ASGTV', x[6]) THEN x[6] ELSE 'A' END AS fixed FROM b WHERE rn = 1)
SELECT doc_id, name, penalty::BIGINT AS penalty, fixed, md5(fixed || t) AS whole FROM f""",
    "pattern_counts": f"""WITH q AS (SELECT doc_id, {SEQ} AS s FROM documents), p(pattern) AS (VALUES ('N[^P][ST][^P]'), ('TH.{{2,3}}R'), ('^[AT].{{2}}E'), ('C..C'), ('[RK]{{2}}.[DE]')),
c AS (SELECT doc_id, 'N[^P][ST][^P]' AS pattern, len(regexp_extract_all(s, 'N[^P][ST][^P]')) AS n FROM q UNION ALL SELECT doc_id, 'TH.{{2,3}}R', len(regexp_extract_all(s, 'TH.{{2,3}}R')) FROM q UNION ALL SELECT doc_id, '^[AT].{{2}}E', len(regexp_extract_all(s, '^[AT].{{2}}E')) FROM q
 UNION ALL SELECT doc_id, 'C..C', len(regexp_extract_all(s, 'C..C')) FROM q UNION ALL SELECT doc_id, '[RK]{{2}}.[DE]', len(regexp_extract_all(s, '[RK]{{2}}.[DE]')) FROM q)
SELECT doc_id, pattern, n::BIGINT AS n FROM c WHERE n > 0""",
    "pattern_scan": f"""WITH q AS (SELECT doc_id, {SEQ} AS s FROM documents), p(pattern, r) AS (VALUES ('N[^P][ST][^P]', 'N[^P][ST][^P]'), ('TH.{{2,3}}R', 'TH.{{2,3}}R'), ('C..C', 'C..C'), ('[RK]{{2}}.[DE]', '[RK]{{2}}.[DE]')),
m AS (SELECT doc_id, pattern, s, len(regexp_extract_all(s, r)) AS n, regexp_split_to_array(s, r) AS parts FROM q, p)
SELECT doc_id, pattern, n::BIGINT AS n, length(parts[1])::BIGINT AS first, (length(s) - length(parts[-1]))::BIGINT AS last FROM m WHERE n > 0
UNION ALL SELECT doc_id, '^[AT].{{2}}E', 1, 0, 4 FROM q WHERE regexp_matches(s, '^[AT].{{2}}E')""",
    "mask_windows": f"""WITH q AS (SELECT doc_id, {SEQ} AS s FROM documents), m AS (SELECT doc_id, s, unnest(list_filter(range(0, 80), lambda i: (i >= 2 AND i < 23 OR i >= 57 AND i < 73) AND i NOT IN (6, 7, 64))) AS i FROM q)
SELECT q.doc_id, coalesce(string_agg(i::VARCHAR, ',' ORDER BY i) FILTER (i < length(m.s)), '') AS masked FROM q LEFT JOIN m USING (doc_id) GROUP BY q.doc_id""",
    "blocked_points": f"""WITH q AS (SELECT doc_id, length({SEQ}) AS n FROM documents), b AS (SELECT doc_id, n, list_filter(range(0, n), lambda p: p % 9 < 2 AND p NOT IN (0, 10)) AS x,
 list_distinct(list_transform(range(0, 24), lambda k: least(greatest(round_even(n * (k // 8) / 3.0::DOUBLE + (n * (k // 8 + 1) / 3.0::DOUBLE - n * (k // 8) / 3.0::DOUBLE) * (k % 8) / 7, 0)::INT, 0), n))) AS y FROM q)
SELECT doc_id, len(x) AS n_blocked, coalesce(list_sum(x), 0)::BIGINT AS sum_blocked, len(y) AS n_points, coalesce(list_sum(y), 0)::BIGINT AS sum_points FROM b""",
    "session_rounds": f"""WITH {EVENTS}, c AS (SELECT user_id AS session, event_id // 500 AS round, tool || '-' || event_id % 17 AS candidate, score FROM e WHERE success),
f AS (SELECT session, candidate, min(round) AS round FROM c GROUP BY ALL), b AS (SELECT session, round, candidate, max(score) AS score FROM c GROUP BY ALL),
r AS (SELECT b.session, b.round, count(f.candidate) AS n_new, max(b.score) FILTER (f.candidate IS NOT NULL) AS best_round FROM b LEFT JOIN f USING (session, candidate, round) GROUP BY ALL),
w AS (SELECT *, max(best_round) OVER (PARTITION BY session ORDER BY round ROWS UNBOUNDED PRECEDING) AS best, max(best_round) OVER (PARTITION BY session ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM r)
SELECT session, round, n_new, round(best_round, 6) AS best_round, round(best, 6) AS best, round(CASE WHEN p IS NULL THEN best ELSE best - p END, 6) AS delta FROM w""",
    "stream_session_topk": """WITH b AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL)
SELECT user_id, event_id, value, rank FROM b WHERE rank <= 3""",
}
