"""Queries over annotated entries: feature buckets and locks, cofactor classes, collected fields, relaxed queries, masks, codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import entries as E
from ..functions import seq as S
from ..functions import text as T
from ..sources.tables import table
from .evaluation import SEQ, sequences
from .records import STOP

TYPES = ["Binding site", "ACT_SITE", "Motif", "DOMAIN", "Metal-binding", "region", "Chain"]


def _listed(spans):
    return F.array_join(F.transform(spans, lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",")


def feature_buckets(spark, d):
    """Lines of an order as features of an entry: their types normalised, places read from JSON, dealt into six buckets."""
    n = lambda c: F.col(c).cast("string")
    one = F.concat(F.lit('{"position":{"value":'), n("l_linenumber"), F.lit("}}"))
    two = F.concat(F.lit('{"start":{"value":'), n("l_suppkey"), F.lit('},"end":{"value":"'), n("l_partkey"), F.lit('"}}'))
    flat = F.concat(F.lit('{"begin":'), n("l_suppkey"), F.lit(',"end":"?"}'))
    kind = F.element_at(F.array(*[F.lit(t) for t in TYPES]), (F.col("l_partkey") % len(TYPES) + 1).cast("int"))
    place = E.location(F.when(F.col("l_suppkey") % 3 == 0, one).when(F.col("l_suppkey") % 3 == 1, two).otherwise(flat))
    lines = table(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", kind.alias("type"), place.alias("p")).alias("f"))
    entries = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("f")).alias("features"))  # an order has a few lines
    return entries.select("l_orderkey", *[_listed(F.transform(c, lambda f: f["p"])).alias(b) for b, c in E.bucketed(F.col("features")).items()])


def feature_locks(spark, d):
    """Letters locked by an entry's features, wherever the entry keeps them; ends are swapped and cut to the sequence."""
    at = lambda k, w: F.array(F.struct((F.col("doc_id") * k % 97 - 3).cast("int").alias("start"), ((F.col("doc_id") * k % 97) + w).cast("int").alias("end")))
    some = lambda m, c: F.when(F.col("doc_id") % m == 0, c)
    spans = E.gathered({"active_sites": some(2, at(7, -5)), "motifs": at(11, 2)}, {"binding_sites": some(3, at(13, 1)), "active_sites": some(5, at(17, 0)), "regions": some(7, at(19, 4)), "metal_binding": at(23, 9)})
    locks = S.locks(F.col("seq"), E.half_open(spans, F.length("seq")))
    pairs = F.array_sort(F.map_entries(locks))
    return sequences(spark, d).select("doc_id", F.array_join(F.transform(pairs, lambda e: F.concat((e["key"] + 1).cast("string"), F.lit(":"), e["value"])), " ").alias("locked"))


NAMES = ["Mg2+ ion", "zinc finger", "cofactor: MN", "Heme-C, covalent", "haem group", "NADP", "FAD binding.", "PLP; lysine", "biotin", "4Fe-4S cluster", "Coenzyme  A", "thiamine pyrophosphate", "S-adenosylmethionine", "EF-hand CA2+", "p-loop ATP (EC 2.7.11.1)", "cytochrome c 1.2.3.4", "EC: 3.1", "nothing"]


def cofactor_classes(spark, d):
    """Classes of stated cofactors by name and by description, the words and enzyme classes in them, and a phrase to search by."""
    p = table(spark, d, "part")
    text = F.concat(F.element_at(F.array(*[F.lit(x) for x in NAMES]), (F.col("p_partkey") % len(NAMES) + 1).cast("int")), F.lit(" "), F.col("p_name"))
    t = p.select("p_partkey", "p_type", text.alias("t"))
    sides = E.reaction_sides(F.concat(F.col("t"), F.lit(" + "), F.col("p_type"), F.lit(" = "), F.col("p_type"), F.lit(" + ")))
    return t.select("p_partkey", E.first_class(F.col("t"), E.COFACTOR_RULES, "").alias("by_name"), E.first_class(F.col("t"), E.PATTERN_TEXT_RULES, "unknown").alias("by_text"), F.array_join(E.cofactor_words(F.col("t")), " ").alias("words"), F.array_join(E.all_ecs(F.col("t")), " ").alias("ecs"), E.search_phrase(F.col("t")).alias("phrase"), F.size(sides).cast("long").alias("n_sides"))


def document_cofactors(spark, d):
    """The class that each whole document's text names first in the rules' order, and how many documents of a source it has."""
    t = table(spark, d, "documents").select("source", E.first_class(F.col("text"), E.COFACTOR_RULES, "").alias("by_name"), E.first_class(F.col("text"), E.PATTERN_TEXT_RULES, "unknown").alias("by_text"))
    return t.groupBy("source", "by_name", "by_text").agg(F.count("*").alias("n"))


def entry_fields(spark, d):
    """Parts as nested entries in JSON whose lists mix texts and objects; reviewed ones alone, their fields as plain lists."""
    p = table(spark, d, "part")
    n, s, q = F.col("p_partkey").cast("string"), F.col("p_size").cast("string"), lambda *c: F.concat(F.lit('"'), *c, F.lit('"'))
    js = F.concat(
        F.lit('{"entryType":'), F.when(F.col("p_partkey") % 2 == 0, q(F.lit("Swiss-Prot"))).otherwise(q(F.lit("TrEMBL"))),
        F.lit(',"ecNumbers":["1.'), s, F.lit('",{"value":"2.'), s, F.lit('"},{"id":"3.1"},{}]'),
        F.lit(',"keywords":[{"name":'), q(F.col("p_type")), F.lit('},{"value":"k'), s, F.lit('"}]'),
        F.lit(',"go_p":[{"term":"T'), n, F.lit('"}],"goTerms":[{"id":"GO:'), n, F.lit('"}]'),
        F.lit(',"cc_cofactor":["zn",{"name":"mg"}],"cc_catalytic_activity":["a RHEA:'), n, F.lit(' b Rhea:7"]'),
        F.lit(',"comments":[{"commentType":"COFACTOR","cofactors":[{"cofactor":{"name":"fad'), s, F.lit('"}},{}]}'),
        F.lit(',{"commentType":"PATHWAY","text":['), q(F.col("p_brand")), F.lit(',{"value":"glycolysis"}]},{"commentType":"PATHWAY","value":"plain"}'),
        F.lit(',{"commentType":"CATALYTIC_ACTIVITY","reaction":{"rheaId":"'), s, F.lit('"}},{"commentType":"FUNCTION","texts":["does x",{"value":"does '), s, F.lit('"}]}]}'),
    )
    entries = p.select("p_partkey", F.from_json(js, E.ENTRY).alias("e")).filter("e.entryType = 'Swiss-Prot'")
    return entries.select("p_partkey", *[F.array_join(c, "|").alias(k) for k, c in E.collected(F.col("e")).items()])


def query_plan(spark, d):
    """From strict to loose: the whole phrase, the most telling tokens together, fewer of them, any of them, runs of them."""
    t = table(spark, d, "benchmark").select("item_id", F.coalesce("text", F.lit("")).alias("t"))
    rows = t.select("item_id", F.trim(F.regexp_replace("t", r"\s+", " ")).alias("full"), T.query_tokens(F.col("t"), STOP).alias("terms"))
    return rows.select("item_id", F.explode(T.query_variants(F.col("full"), F.col("terms"))).alias("v")).select("item_id", "v.label", "v.query")


def keep_marks(spark, d):
    """Kept letters of each sequence: two spans and every occurrence, also overlapping ones, of two words."""
    mask = E.keep_mask(F.col("seq"), [(5, 12), (40, 44)], ["ANA", "EE"])
    return sequences(spark, d).select("doc_id", F.length(F.replace(mask, F.lit("."), F.lit(""))).cast("long").alias("n_kept"), F.md5(mask).alias("mask"))


def masked_structure(spark, d):
    """Letters and structure letters in turn, structure of little confidence as a hash mark."""
    s = sequences(spark, d)
    structure = F.split(F.translate("seq", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "DVPQLNCSGKEATHRYFMIWZXBJUO"), "")
    confidence = F.transform(F.split("seq", ""), lambda x, i: (F.ascii(x) * 31 + i * 17 + F.col("doc_id")) % 100)
    return s.select("doc_id", F.md5(E.interleaved(F.split("seq", ""), structure, confidence, 70)).alias("pairs"))


def part_codes(spark, d):
    """Codes of equal length for parts in the order of their keys, those beyond 1500 as a hash mark, and maps with number keys."""
    p = table(spark, d, "part")
    pairs = F.from_json(F.concat(F.lit('{"'), F.col("p_size").cast("string"), F.lit('":"A","x":"B"," -7 ":"C","1.5":"D"}')), "map<string,string>")
    kept = F.array_sort(F.map_entries(E.int_keys(pairs)))
    return p.select("p_partkey", E.code(F.col("p_partkey"), "pynwrqhgdlvtmfsaeikc", 1500).alias("code"), F.array_join(F.transform(kept, lambda e: F.concat(e["key"].cast("string"), e["value"])), " ").alias("locked"), F.regexp_replace(F.upper("p_name"), "[^ACDEFGHIKLMNPQRSTVWXY]", "X").alias("motif"))


QUERIES = {f.__name__: f for f in (feature_buckets, feature_locks, cofactor_classes, document_cofactors, entry_fields, query_plan, keep_marks, masked_structure, part_codes)}

STRUCTURE = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'DVPQLNCSGKEATHRYFMIWZXBJUO')"


def _case(rules, otherwise, text):
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '{r}') THEN '{n}'" for n, r in rules) + f" ELSE '{otherwise}' END"


def _lock(k, w, m):
    return f"SELECT doc_id, s, greatest(least(doc_id * {k} % 97 - 3, doc_id * {k} % 97 + {w}), 1) AS a, least(greatest(doc_id * {k} % 97 - 3, doc_id * {k} % 97 + {w}), length(s)) AS b FROM q WHERE doc_id % {m} = 0"


_LISTED = "string_agg(coalesce(a::VARCHAR, '') || CASE WHEN a IS NULL OR b IS NULL THEN '' ELSE '-' END || coalesce(b::VARCHAR, ''), ',' ORDER BY l_linenumber, l_partkey, l_suppkey)"
_LOW = "lower(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'), ' '))"
_QUOTED = ", ".join(f"'{x}'" for x in NAMES)
_TOKENS = "list_filter(f, lambda v, i: list_position(f, v) = i AND length(v) >= 3 AND lower(v) NOT IN (" + ", ".join(f"'{w}'" for w in STOP) + ") AND NOT regexp_full_match(v, '[0-9]+'))"

ORACLES = {
    "feature_buckets": "WITH f AS (SELECT *, CASE l_suppkey % 3 WHEN 0 THEN l_linenumber ELSE l_suppkey END AS a, CASE l_suppkey % 3 WHEN 0 THEN l_linenumber WHEN 1 THEN l_partkey END AS b, l_partkey % 7 AS k FROM lineitem) SELECT l_orderkey, "
    + ", ".join(f"{_LISTED} FILTER (k = {i}) AS {b}" for b, i in (("binding_sites", 0), ("metal_binding", 4), ("active_sites", 1), ("motifs", 2), ("domains", 3), ("regions", 5)))
    + " FROM f GROUP BY l_orderkey",
    "feature_locks": f"WITH q AS (SELECT doc_id, {SEQ} AS s FROM documents), l AS ({' UNION ALL '.join(_lock(*x) for x in ((7, -5, 2), (11, 2, 1), (13, 1, 3), (17, 0, 5), (19, 4, 7)))}), p AS (SELECT DISTINCT doc_id, s, unnest(range(a, b + 1)) AS p FROM l WHERE a <= b), g AS (SELECT doc_id, string_agg(p || ':' || substring(s, p, 1), ' ' ORDER BY p) AS locked FROM p GROUP BY doc_id) SELECT doc_id, coalesce(locked, '') AS locked FROM q LEFT JOIN g USING (doc_id)",
    "cofactor_classes": f"""WITH x AS (SELECT p_partkey, p_type, [{_QUOTED}][p_partkey % {len(NAMES)} + 1] || ' ' || p_name AS text FROM part), y AS (SELECT *, {_LOW} AS low, trim(regexp_replace(regexp_replace(regexp_extract(text, '^[^，,;；。.]*'), '[^0-9A-Za-z \\-+()]', ' ', 'g'), '\\s+', ' ', 'g'), ' ') AS h FROM x)
SELECT p_partkey, {_case(E.COFACTOR_RULES, '', 'low')} AS by_name, {_case(E.PATTERN_TEXT_RULES, 'unknown', 'low')} AS by_text, array_to_string(list_filter([{', '.join(f"'{w}'" for w in E.COFACTOR_WORDS)}], lambda w: contains(lower(text), lower(w))), ' ') AS words,
CASE p_partkey % {len(NAMES)} WHEN 14 THEN '2.7.11.1' WHEN 15 THEN '1.2.3.4' WHEN 16 THEN '3.1' ELSE '' END AS ecs, CASE WHEN h <> '' THEN h || '*' ELSE '' END AS phrase, len(list_filter(regexp_split_to_array(text || ' + ' || p_type || ' = ' || p_type || ' + ', '[=+]'), lambda v: trim(v, ' ') <> '')) AS n_sides FROM y""",
    "document_cofactors": f"WITH x AS (SELECT source, {_LOW} AS low FROM documents) SELECT source, {_case(E.COFACTOR_RULES, '', 'low')} AS by_name, {_case(E.PATTERN_TEXT_RULES, 'unknown', 'low')} AS by_text, count(*) AS n FROM x GROUP BY ALL",
    "entry_fields": "SELECT p_partkey, '1.' || p_size || '|2.' || p_size || '|3.1' AS ecs, p_type || '|k' || p_size AS keywords, 'T' || p_partkey || '|GO:' || p_partkey AS terms, 'ZN|MG|FAD' || p_size AS cofactors, p_brand || '|glycolysis|plain' AS pathways, p_partkey || '|7|' || p_size AS reactions, 'does x|does ' || p_size AS functions FROM part WHERE p_partkey % 2 = 0",
    "query_plan": f"""WITH x AS (SELECT item_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'), ' ') AS full_text, regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9\\-()+./]+') AS f FROM benchmark), k AS (SELECT item_id, full_text, {_TOKENS} AS f FROM x),
o AS (SELECT item_id, list(v ORDER BY NOT regexp_matches(v, '[\\-()+0-9A-Z]'), -length(v), i) AS t FROM (SELECT item_id, unnest(f) AS v, unnest(range(1, len(f) + 1)) AS i FROM k) GROUP BY item_id), n AS (SELECT item_id, full_text, coalesce(t, []) AS t, len(coalesce(t, [])) AS n FROM k LEFT JOIN o USING (item_id)),
g AS (SELECT item_id, full_text, t, n, list_concat(list_transform(range(1, greatest(n - 1, 1)), lambda i: array_to_string(t[i:i + 2], ' ')), list_transform(range(1, greatest(n, 1)), lambda i: array_to_string(t[i:i + 1], ' ')))[1:12] AS g FROM n)
SELECT item_id, 'Q1_full_phrase' AS label, '"' || full_text || '"' AS query FROM g WHERE full_text <> ''
UNION ALL SELECT item_id, 'Q2_and_top' || k, array_to_string(t[1:k], ' ') FROM g, (VALUES (5), (4), (3)) v(k) WHERE n >= k
UNION ALL SELECT item_id, 'Q3_and_' || k, array_to_string(t[1:k], ' ') FROM g, (VALUES (4), (3), (2)) v(k) WHERE k < least(5, n)
UNION ALL SELECT item_id, 'Q4_or_top', array_to_string(t[1:least(10, greatest(6, n))], ' OR ') FROM g WHERE n > 0
UNION ALL SELECT item_id, 'Q5_ngram_or', array_to_string(g, ' OR ') FROM g WHERE len(g) > 0""",
    "keep_marks": f"""WITH q AS (SELECT doc_id, {SEQ} AS s FROM documents), l AS (SELECT doc_id, unnest(range(1, length(s) + 1)) AS i, unnest(string_split(s, '')) AS c FROM q WHERE length(s) > 0),
n AS (SELECT doc_id, i, c, coalesce(lag(c, 2) OVER w, '.') || coalesce(lag(c) OVER w, '.') || c || coalesce(lead(c) OVER w, '.') || coalesce(lead(c, 2) OVER w, '.') AS x FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
m AS (SELECT doc_id, string_agg(CASE WHEN i BETWEEN 6 AND 12 OR i BETWEEN 41 AND 44 OR contains(x, 'ANA') OR x LIKE '_EE__' OR x LIKE '__EE_' THEN '#' ELSE '.' END, '' ORDER BY i) AS m FROM n GROUP BY doc_id)
SELECT doc_id, length(replace(coalesce(m, ''), '.', '')) AS n_kept, md5(coalesce(m, '')) AS mask FROM q LEFT JOIN m USING (doc_id)""",
    "masked_structure": f"""WITH q AS (SELECT doc_id, {SEQ} AS s FROM documents), r AS (SELECT doc_id, string_split(s, '') AS a, string_split({STRUCTURE.format('s')}, '') AS b FROM q)
SELECT doc_id, md5(CASE WHEN a = [''] OR len(a) = 0 THEN CASE WHEN doc_id % 100 < 70 THEN '#' ELSE '' END ELSE array_to_string(list_transform(a, lambda x, i: x || CASE WHEN (ascii(x) * 31 + (i - 1) * 17 + doc_id) % 100 < 70 THEN '#' ELSE lower(b[i]) END), '') END) AS pairs FROM r""",
    "part_codes": """WITH p AS (SELECT *, p_partkey AS i, 'pynwrqhgdlvtmfsaeikc' AS l FROM part) SELECT p_partkey, CASE WHEN i < 1500 THEN l[(i // 400 % 20 + 1)::INT] || l[(i // 20 % 20 + 1)::INT] || l[(i % 20 + 1)::INT] ELSE '#' END AS code, '-7C ' || p_size || 'A' AS locked, regexp_replace(upper(p_name), '[^ACDEFGHIKLMNPQRSTVWXY]', 'X', 'g') AS motif FROM p""",
}
