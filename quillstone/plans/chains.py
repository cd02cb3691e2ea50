"""Queries over chains: from a text to one document of rules, from a description to a motif."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import design as D
from ..functions import entries as E
from ..functions import text as T
from ..operators import chains, motifs
from ..operators import sequences as Q
from ..sources.tables import table
from .evaluation import SEQ, _count, sequences
from .rules import _LETTERS, TOLD

#: What a user may ask for; each document asks for three of these.
WANTED = ["Mg2+ ion", "4Fe-4S cluster", "heme c", "Zinc finger", "ATP", "NADP+", "FAD", "pyridoxal phosphate", "SAM", "coenzyme  A", "phosphate loop", "biotin", "P-loop that binds", "calcium ring", "a pocket", "heme site"]
_ASKS = "[{w}][n % 16 + 1] || '; ' || [{w}][n // 16 % 16 + 1] || ',, ' || [{w}][n % 7 + 1]"


def request():
    n = F.coalesce(F.col("n_chars"), F.lit(0))
    one = lambda at: F.element_at(F.array(*[F.lit(w) for w in WANTED]), at.cast("int") + 1)
    return F.concat(one(n % 16), F.lit("; "), one(F.floor(n / 16) % 16), F.lit(",, "), one(n % 7))


def chained_rules(spark, d):
    """What each document asks for as one document of rules for its sequence; those with an odd id start from a base."""
    docs = table(spark, d, "documents").select("doc_id", request().alias("request"), T.letters(F.coalesce("text", F.lit(""))).alias("s"))
    locked = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length("s") - 1), F.lit(23))
    shell = lambda allow, forbid, most: chains.fragment(F.array(*map(F.lit, allow)), F.array(*map(F.lit, forbid)), F.lit(None), F.lit(None), most)
    base = F.when(F.col("doc_id") % 2 == 1, shell(["K"], ["QQ", "[KR]{6,}"], F.lit(None))).otherwise(shell([], [], F.lit(D.MOST_CYS)))
    r = chains.cofactor_documents(docs, "doc_id", F.col("s"), F.col("request"), locked, base, TOLD)
    rule = lambda x: F.concat_ws(":", x["kind"], x["first"].cast("string"), x["last"].cast("string"), x["what"], x["value"].cast("string"))
    return r.select("doc_id", "n_parts", F.array_join("allow", " ").alias("regex_allow"), F.array_join("forbid", " ").alias("regex_forbid"), F.array_join(F.transform("rules", rule), "|").alias("rules"), F.array_join("motifs", ",").alias("motifs"), "most_cys", "detected", "first", "last", "overlap", "auto_key", "auto_used", "found", "asked")


#: Classes of motifs as a user's table would have them: class, name, description, pattern.
CLASSES = [("DOC_RING", "small ring", "ring with zinc, economy", "C.{2}C"), ("LIG_LOOP", "P-loop", "binds ATP in a standard loop", "[RK]{2}G[ST]"), ("LIG_GEAR", "blue gear", "promo gear", "GAGAAG"), ("MOD_WIDGET", "widget", "red widget site", "K[ST]{2}A"), ("TRG_LONG", "large bolt", "a long run of acids", "[DE]{30}"), ("LIG_HEME", "heme", "heme site", "HA{2}H")]
FORBID = ["AGA", "CC", "K[ST]{2}A"]


def motif_resolution(spark, d):
    """A motif for what each part's name and type ask for, out of the sequences of all documents, put behind the motifs that it has."""
    classes = spark.createDataFrame(CLASSES, "class string, name string, about string, pattern string")  # a fixed list
    spans = sequences(spark, d).select("doc_id", "seq", F.explode(Q.pattern_spans(F.col("seq"), [p for *_, p in CLASSES])).alias("x"))
    # Of a class's places the longest, then the first in the first document.
    letters = F.expr("substring(seq, x.s + 1, x.e - x.s)")
    found = spans.groupBy(F.element_at(F.array(*[F.lit(c[0]) for c in CLASSES]), F.col("x.i") + 1).alias("class")).agg(F.count("*").alias("n"), F.min_by(letters, F.struct(F.col("x.s") - F.col("x.e"), F.col("doc_id"), F.col("x.s"))).alias("letters"))
    parts = table(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("text"), F.when(F.col("p_size") % 2 == 0, F.array(F.lit("CAAC"))).otherwise(F.array(F.lit("KSSG"), F.lit("KSSG"))).alias("had"))
    r = motifs.resolved(parts, "text", classes.join(found.select("class", "n"), "class", "left"), found, FORBID)
    both = F.array_distinct(F.concat("had", F.coalesce(F.array(F.col("motif")), F.array().cast("array<string>"))))
    return parts.join(r, "text", "left").select("p_partkey", "class", "score", "motif", "source", F.array_join(both, ",").alias("motifs"))


QUERIES = {f.__name__: f for f in (chained_rules, motif_resolution)}

_W = ", ".join(f"'{w}'" for w in WANTED)
_RULES = ", ".join(f"({i}, '{c}', '{k}', '{p}', '{w}', {v}::DOUBLE, {n})" for i, (c, k, p, w, v, n) in enumerate(D.RULES))
_CASE = lambda rules, low: "CASE " + " ".join(f"WHEN regexp_matches({low}, '{r}') THEN '{c}'" for c, r in rules) + " ELSE 'unknown' END"
_DESIRE = "CASE " + " ".join(f"WHEN class = '{c}' THEN '{x}'" for c, x in D.DESIRES.items()) + " ELSE '' END"
_AUTO = "CASE WHEN lower({0}) IN ('nadp', 'nad', 'flavin', 'fmn', 'fad') THEN 'auto_nad' WHEN regexp_matches(lower({0}), 'ntp|atp|gtp') THEN 'auto_atp_gtp' WHEN contains(lower({0}), 'phosphate') THEN 'auto_phosphate' END"
_TOLD = ", ".join(f"({i}, '{p}', '{t}', '{_LETTERS[i]}')" for i, (p, t) in enumerate(TOLD))
_SCANS = " UNION ALL ".join(f"SELECT doc_id, s, {i} AS i, regexp_extract_all(s, '{p}') AS m, regexp_split_to_array(s, '{p}') AS g FROM q" for i, (p, _) in enumerate(TOLD))
_WANT = f"(CASE WHEN desire = '' THEN 0 ELSE length(s) - length(translate(s, desire, '')) END)"
_NET = f"({_count('KRH')} - {_count('DE')})"
_AT = "CASE WHEN divisor > 0 THEN greatest(1, (last - first + 1) // divisor)::DOUBLE ELSE value END"
_TEXT = f"kind || ':' || first || ':' || last || ':' || what || ':' || ({_AT})::VARCHAR"

ORACLES = {
    "chained_rules": f"""WITH q AS (SELECT doc_id, {SEQ} AS s, {_ASKS.format(w=_W)} AS request FROM (SELECT *, coalesce(n_chars, 0) AS n FROM documents)),
u AS (SELECT doc_id, s, list_filter(list_transform(regexp_split_to_array(request, '[;,]'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') AS a FROM q),
i AS (SELECT doc_id, length(s) AS n, len(a) AS n_parts, unnest(range(1, len(a) + 1)) AS k, unnest(a) AS item FROM u),
c AS (SELECT *, {_CASE(E.COFACTOR_RULES, 'lower(item)')} AS class FROM i),
d AS (SELECT *, {_DESIRE} AS desire, CASE WHEN class = 'unknown' THEN item ELSE class END AS auto_key FROM c),
w AS (SELECT doc_id, start, t[start + 1:start + 16] AS s, len(list_filter(range(0, greatest(length(t), 1), 23), lambda p: p >= start AND p < start + 16)) AS overlap FROM (SELECT doc_id, s AS t, unnest(range(0, greatest(length(s) - 16, 0) + 1, 4)) AS start FROM q)),
l AS (SELECT doc_id, start, unnest(range(1, length(s) + 1)) AS j, unnest(string_split(s, '')) AS x FROM w WHERE length(s) > 0), g AS (SELECT *, j - row_number() OVER (PARTITION BY doc_id, start, x ORDER BY j) AS g FROM l),
run AS (SELECT doc_id, start, max(z) AS run FROM (SELECT doc_id, start, x, g, count(*) AS z FROM g GROUP BY ALL) GROUP BY ALL),
v AS (SELECT doc_id, desire, start, overlap, CASE WHEN length(s) < 16 THEN 1e9::DOUBLE ELSE round(0.8::DOUBLE - {_WANT} / 16.0::DOUBLE + 0.3::DOUBLE * ({_count('PG')} / 16.0::DOUBLE) + 0.3::DOUBLE * coalesce(run, 0) / 16.0::DOUBLE
 + 0.2::DOUBLE * CASE WHEN desire = 'DE' THEN -least(0, {_NET}) WHEN desire IN ('CH', 'FWY') THEN greatest(0, -{_NET}) ELSE 0 END, 6) END AS score FROM w LEFT JOIN run USING (doc_id, start) JOIN (SELECT DISTINCT doc_id, desire FROM d) USING (doc_id)),
b AS (SELECT doc_id, desire, arg_min(start, (overlap, score, start)) AS start, arg_min(overlap, (overlap, score, start)) AS overlap FROM v GROUP BY ALL),
p AS (SELECT d.*, CASE WHEN class NOT IN ('heme_c', 'fe_s') THEN start + 1 END AS first, CASE WHEN class NOT IN ('heme_c', 'fe_s') THEN start + 16 END AS last, CASE WHEN class NOT IN ('heme_c', 'fe_s') THEN overlap END AS overlap FROM d JOIN b USING (doc_id, desire)),
r(o, rule, kind, place, what, value, divisor) AS (VALUES {_RULES}), told(i, pattern, told, letters) AS (VALUES {_TOLD}), x AS ({_SCANS}),
y AS (SELECT doc_id, s, i, unnest(range(1, len(m) + 1)) AS j, unnest(m) AS m, unnest(g[1:len(m)]) AS g FROM x),
h AS (SELECT doc_id, length(s) AS n, i, length(m) AS z, sum(length(g) + length(m)) OVER (PARTITION BY doc_id, i ORDER BY j) AS e FROM y),
f AS (SELECT doc_id, nth, pattern, told, greatest(1, (e - z + 1 + e) // 2 - greatest(16, z) // 2) AS first, greatest(16, z) AS wide, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY z DESC, i, e) AS nth FROM h) JOIN told USING (i) WHERE nth <= 5),
pool AS (SELECT doc_id, string_agg(told, ' ' ORDER BY nth) AS told, count(*) AS found FROM f GROUP BY doc_id),
sc AS (SELECT *, {_AUTO.format('scanned')} AS auto FROM (SELECT p.*, {_CASE(E.PATTERN_TEXT_RULES, "lower(item || ' ' || pool.told)")} AS scanned FROM p JOIN pool USING (doc_id))),
spans AS (SELECT doc_id, k, nth, first::BIGINT AS first, last::BIGINT AS last, row_number() OVER (PARTITION BY doc_id, k ORDER BY nth) AS turn FROM (SELECT doc_id, k, 0 AS nth, first, last FROM p WHERE first IS NOT NULL UNION ALL SELECT f.doc_id, k, nth, f.first, least(f.n, f.first + wide - 1) FROM f JOIN i USING (doc_id))),
ts AS (SELECT doc_id, k, i, pattern, letters, CASE WHEN contains(lower(told), lower(item)) THEN 5 ELSE 0 END + len(list_filter(regexp_extract_all(lower(item), '[a-z0-9]+'), lambda z: list_contains(regexp_extract_all(lower(told), '[a-z0-9]+'), z))) AS score FROM i, told),
t3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, k ORDER BY score DESC, i) AS nth FROM ts WHERE score > 0) WHERE nth <= 3),
au AS (SELECT *, {_AUTO.format('auto_key')} AS auto FROM p), weak AS (SELECT o, what FROM r WHERE rule = 'auto'),
part_rules AS (SELECT doc_id, k, 0 AS f, n, first, last, class AS rule FROM p UNION ALL SELECT doc_id, k, 3, n, first, last, auto FROM au),
every AS (SELECT doc_id, -1 AS k, 0 AS f, j AS o, list, v FROM q, (VALUES (0, 'allow', 'K'), (0, 'forbid', 'QQ'), (1, 'forbid', '[KR]{{6,}}')) z(j, list, v) WHERE doc_id % 2 = 1
UNION ALL SELECT doc_id, k, f, o, CASE kind WHEN 'regex_allow' THEN 'allow' WHEN 'regex_forbid' THEN 'forbid' ELSE 'motif' END, what FROM part_rules JOIN r USING (rule) WHERE kind IN ('regex_allow', 'regex_forbid', 'motif')
UNION ALL SELECT doc_id, k, f, o, 'rules', {_TEXT} FROM part_rules JOIN r USING (rule) WHERE place = 'span' AND first IS NOT NULL
UNION ALL SELECT doc_id, k, f, 90000 + o, 'rules', {_TEXT} FROM (SELECT doc_id, k, f, rule, 1 AS first, n AS last FROM part_rules) JOIN r USING (rule) WHERE place = 'whole'
UNION ALL SELECT doc_id, k, 3, o - 1000, 'forbid', what FROM au, weak
UNION ALL SELECT doc_id, k, 1, o, 'forbid', what FROM sc, weak UNION ALL SELECT doc_id, k, 1, nth, 'allow', pattern FROM f JOIN i USING (doc_id)
UNION ALL SELECT doc_id, k, 1, turn * 1000 + o, 'rules', {_TEXT} FROM (SELECT s.*, auto AS rule FROM spans s JOIN sc USING (doc_id, k) WHERE turn <= 3) JOIN r USING (rule) WHERE place = 'span'
UNION ALL SELECT doc_id, k, 1, 90000 + o, 'rules', {_TEXT} FROM (SELECT doc_id, k, auto AS rule, 1 AS first, n AS last FROM sc) JOIN r USING (rule) WHERE place = 'whole'
UNION ALL SELECT doc_id, k, 2, nth, 'allow', pattern FROM t3 UNION ALL SELECT doc_id, k, 2, 0, 'motif', letters FROM t3 WHERE nth = 1 UNION ALL SELECT doc_id, k, 2, o, 'forbid', what FROM t3, weak WHERE nth = 1
UNION ALL SELECT doc_id, k, 0, 0, 'motif', '' FROM p WHERE class <> 'heme_c' UNION ALL SELECT doc_id, k, 3, 0, 'motif', '' FROM p UNION ALL SELECT doc_id, k, 1, 0, 'motif', '' FROM sc),
one AS (SELECT doc_id, list, v, min(k * 10000000 + f * 1000000 + o) AS o FROM every GROUP BY ALL),
m AS (SELECT doc_id, any_value(n_parts) AS n_parts, CASE WHEN doc_id % 2 = 0 OR arg_min(class, k) <> 'fe_s' THEN 10 ELSE 12 END AS most_cys, arg_max(class, k) AS detected, max(k) AS k, max(CASE WHEN overlap > 0 THEN k END) AS ko, arg_max(auto_key, k) AS auto_key FROM p GROUP BY doc_id),
agg AS (SELECT doc_id, string_agg(v, ' ' ORDER BY o) FILTER (list = 'allow') AS a, string_agg(v, ' ' ORDER BY o) FILTER (list = 'forbid') AS fo, string_agg(v, '|' ORDER BY o) FILTER (list = 'rules') AS ru, string_agg(v, ',' ORDER BY o) FILTER (list = 'motif') AS mo FROM one GROUP BY doc_id)
SELECT m.doc_id, m.n_parts, coalesce(a, '') AS regex_allow, coalesce(fo, '') AS regex_forbid, coalesce(ru, '') AS rules, coalesce(mo, '') AS motifs, most_cys, detected, pl.first, pl.last, po.overlap, m.auto_key, {_AUTO.format('m.auto_key')} IS NOT NULL AS auto_used, found, ask.asked
FROM m JOIN agg USING (doc_id) JOIN p pl ON pl.doc_id = m.doc_id AND pl.k = m.k LEFT JOIN p po ON po.doc_id = m.doc_id AND po.k = m.ko LEFT JOIN pool ON pool.doc_id = m.doc_id
LEFT JOIN (SELECT doc_id, arg_max(z, k) AS asked FROM (SELECT doc_id, k, count(*) AS z FROM t3 GROUP BY ALL) GROUP BY doc_id) ask ON ask.doc_id = m.doc_id""",
}
