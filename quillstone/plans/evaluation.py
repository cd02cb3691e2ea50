"""Queries over scored and labelled documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import seq as S
from ..functions import text as T
from ..operators import intervals, ranking, summary
from ..operators.constraints import allowed, best_window, charge_ok, min_count_ok, soft_penalty
from ..operators.sequences import letter_counts, pair_entropy
from ..sources.tables import table

SEQ = "upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g'))"
AA = "[ACDEFGHIKLMNPQRSTVWY]"


def sequences(spark, d):
    """doc_id and the letters of the whole text."""
    return table(spark, d, "documents").select("doc_id", T.letters(F.coalesce("text", F.lit(""))).alias("seq"))


def labelled(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    return docs.join(labels, "doc_id", "left").select("doc_id", F.col("n_chars").cast("double").alias("n_chars"), F.length("text").cast("double").alias("text_len"), F.col("quality").isNotNull().alias("has_tag"), (F.coalesce("quality", F.lit(0)) == 1).alias("is_valid"))


def worst_fill_summary(spark, d):
    rows = labelled(spark, d)
    means = summary.worst_fill_mean(rows, {"n_chars": False, "text_len": True}, F.col("is_valid"), F.col("has_tag"))
    ratios = rows.agg(F.avg(F.col("has_tag").cast("int")).alias("has_tag_ratio"), F.avg(F.col("is_valid").cast("int")).alias("is_valid_ratio"))
    return means.join(F.broadcast(ratios)).select(*[F.round(c, 6).alias(c) for c in ("n_chars", "text_len", "has_tag_ratio", "is_valid_ratio")])


def strict_valid_summary(spark, d):
    out = summary.strict_means(labelled(spark, d), ["n_chars", "text_len"], F.col("has_tag"), F.col("is_valid"))
    return out.select(F.round("n_chars", 6).alias("n_chars"), F.round("text_len", 6).alias("text_len"), "n_rows")


LABELLED = """WITH r AS (SELECT d.doc_id, d.n_chars::DOUBLE AS n_chars, length(d.text)::DOUBLE AS text_len, l.quality IS NOT NULL AS has_tag, coalesce(l.quality, 0) = 1 AS is_valid
FROM documents d LEFT JOIN labels l USING (doc_id))"""


def seq_validity(spark, d):
    text = F.coalesce("text", F.lit(""))
    c = table(spark, d, "documents").select("doc_id", S.clean(F.regexp_replace(text, "[^A-Za-z ]", "")).alias("c"), S.restricted(F.regexp_replace(text, "[^A-Za-z]", "")).alias("r"))
    return c.select("doc_id", F.length("c").alias("n_clean"), F.length("r").alias("n_restricted"), S.is_valid(F.col("c")).alias("valid"), S.is_valid(F.col("r")).alias("restricted_valid"))


def validity_reason(spark, d):
    return sequences(spark, d).select("doc_id", S.validity_reason(S.restricted(F.col("seq")), 200, 2000, 3).alias("reason"), S.longest_run(F.col("seq")).cast("long").alias("run"))


RUNS = """runs AS (SELECT doc_id, max(n) AS run FROM (
  SELECT doc_id, count(*) AS n FROM (
    SELECT doc_id, i, c, i - row_number() OVER (PARTITION BY doc_id, c ORDER BY i) AS g FROM (
      SELECT doc_id, unnest(range(1, length(s) + 1)) AS i, unnest(string_split(s, '')) AS c FROM {0} WHERE length(s) > 0))
  GROUP BY doc_id, c, g) GROUP BY doc_id)"""


def composition_charge(spark, d):
    s = F.col("seq")
    # One histogram of letters a row, then sums over it.
    row = sequences(spark, d).select("doc_id", F.length(s).alias("n"), letter_counts("seq").alias("c"))
    c, n = F.col("c"), F.col("n")
    of = lambda letters: S.of_counts(c, letters)
    return row.select("doc_id", "n", (of("KRH") - of("DE")).alias("charge"), of("C").alias("n_cys"), F.round(F.try_divide(of("AVILMFWY").cast("double"), n), 6).alias("hydrophobic"), F.round(F.try_divide(S.hydropathy_of(c), n), 6).alias("hydropathy"))


def _count(letters):
    return f"(length(s) - length(translate(s, '{letters}', '')))"


def kmer_entropy(spark, d):
    """Each sequence's pairs of letters and their entropy; nothing is shuffled."""
    s = sequences(spark, d).filter(F.length("seq") > 1).select("doc_id", pair_entropy("seq").alias("e"))
    return s.select("doc_id", "e.n_kmers", F.round("e.entropy", 6).alias("entropy"))


def best_window_query(spark, d):
    """The window of 40 letters that is richest in aromatic ones and avoids what is locked: every 211th position."""
    locked = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length("seq") - 1), F.lit(211))
    best = sequences(spark, d).select("doc_id", best_window(F.col("seq"), 40, 20, "FWY", locked).alias("b"))
    return best.select("doc_id", F.col("b.overlap").cast("long").alias("overlap"), F.col("b.score").alias("score"), F.col("b.start").cast("long").alias("start"))


def window_rules(spark, d):
    s = F.col("seq")
    return sequences(spark, d).select(
        "doc_id",
        allowed(s, ["TH.R", "ING"], ["XYZ", "QQ"]).alias("regex_ok"),
        min_count_ok(s, [(1, 60, "AEIO", 10), (120, 61, "ST", 5)]).alias("count_ok"),
        charge_ok(s, [(1, 80, -8, 8), (10, 30, None, 2)]).alias("charge_ok"),
        soft_penalty(s, 10, (-5, 5), 3, ["THE", "ZZ"]).cast("long").alias("penalty"),
    )


def interval_rows(spark, d):
    o, l = table(spark, d, "orders"), table(spark, d, "lineitem")
    days = lambda c: F.datediff(c, F.lit("1992-01-01").cast("date"))
    return o.join(l, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("k"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), days("o_orderdate").alias("s"), F.greatest(days("l_shipdate"), days("o_orderdate") + 1).alias("e"))


INTERVALS = """WITH i AS (SELECT o_custkey AS k, l_orderkey AS o, l_linenumber AS n, datediff('day', DATE '1992-01-01', o_orderdate::DATE) AS s,
  greatest(datediff('day', DATE '1992-01-01', l_shipdate::DATE), datediff('day', DATE '1992-01-01', o_orderdate::DATE) + 1) AS e FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"""


def interval_merge(spark, d):
    m = intervals.merge(interval_rows(spark, d), ["k"], "s", "e")
    return m.select("k", F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e"), "n_merged")


def interval_overlap_count(spark, d):
    i = interval_rows(spark, d).groupBy("k", "o").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    a, b = i.select("k", F.col("o").alias("lo"), F.col("s").alias("ls"), F.col("e").alias("le")), i.select("k", F.col("o").alias("ro"), F.col("s").alias("rs"), F.col("e").alias("re"))
    pairs = intervals.overlaps(a, b, ["k"], 64).filter("lo <> ro")
    return pairs.groupBy(F.col("lo").alias("orderkey")).agg(F.count("*").alias("n_overlaps"), F.max("ro").alias("last_other"))


def lock_islands(spark, d):
    parts = table(spark, d, "lineitem").select("l_suppkey", "l_partkey")
    return intervals.islands(parts, ["l_suppkey"], "l_partkey")


def score_histogram(spark, d):
    h = summary.histogram(table(spark, d, "orders"), "o_totalprice", 0.0, 500000.0, 100)
    return h.select(F.col("bucket").cast("long").alias("bucket"), "n", F.round("density", 12).alias("density"), F.round("mu", 4).alias("mu"), F.round("sigma", 4).alias("sigma"))


def equal_shards(spark, d):
    return ranking.equal_shards(table(spark, d, "documents").select("doc_id"), "doc_id", 7)


def lock_map(spark, d):
    s = F.col("seq")
    spans = F.array(*[F.struct(F.lit(a).alias("s"), F.lit(b).alias("e")) for a, b in ((2, 5), (4, 9), (30, 33))])
    m = sequences(spark, d).withColumn("m", S.locks(s, spans))
    fixed = F.array_join(F.transform(F.array_sort(F.map_entries("m")), lambda x: x["value"]), "")
    moved = F.array_join(F.transform(S.shifted(F.array_sort(F.map_keys("m")), F.lit(6), F.lit(3)), lambda x: x.cast("string")), ",")
    return m.select("doc_id", fixed.alias("locked"), moved.alias("moved"), S.insert_at(F.left(s, F.lit(12)), F.lit(6), F.lit("xyz")).alias("inserted"))


def merged_spans(spark, d):
    """Merging inside a row: all places of three letters, each widened, as disjoint intervals."""
    s = sequences(spark, d)
    places = F.filter(F.transform(F.split("seq", ""), lambda c, i: F.when(c.isin("W", "V", "K"), F.struct(i.cast("long").alias("s"), (i + 4).cast("long").alias("e")))), lambda x: x.isNotNull())
    m = s.select("doc_id", S.merged(places).alias("m"))
    return m.select("doc_id", F.size("m").cast("long").alias("n_spans"), S.covered(F.col("m")).alias("n_covered"))


QUERIES = {
    "worst_fill_summary": worst_fill_summary,
    "strict_valid_summary": strict_valid_summary,
    "seq_validity": seq_validity,
    "validity_reason": validity_reason,
    "composition_charge": composition_charge,
    "kmer_entropy": kmer_entropy,
    "best_window": best_window_query,
    "window_rules": window_rules,
    "interval_merge": interval_merge,
    "interval_overlap_count": interval_overlap_count,
    "lock_islands": lock_islands,
    "score_histogram": score_histogram,
    "equal_shards": equal_shards,
    "lock_map": lock_map,
    "merged_spans": merged_spans,
}

ORACLES = {
    "worst_fill_summary": LABELLED + """, w AS (SELECT coalesce(min(n_chars) FILTER (is_valid), min(n_chars)) AS wn, coalesce(max(text_len) FILTER (is_valid), max(text_len)) AS wt FROM r)
SELECT round(avg(CASE WHEN has_tag THEN CASE WHEN is_valid AND n_chars IS NOT NULL THEN n_chars ELSE wn END END), 6) AS n_chars,
 round(avg(CASE WHEN has_tag THEN CASE WHEN is_valid AND text_len IS NOT NULL THEN text_len ELSE wt END END), 6) AS text_len,
 round(avg(has_tag::INT), 6) AS has_tag_ratio, round(avg(is_valid::INT), 6) AS is_valid_ratio FROM r, w""",
    "strict_valid_summary": LABELLED + " SELECT round(avg(n_chars), 6) AS n_chars, round(avg(text_len), 6) AS text_len, count(*) AS n_rows FROM r WHERE has_tag AND is_valid",
    "seq_validity": f"""WITH c AS (SELECT doc_id, upper(replace(regexp_replace(coalesce(text, ''), '[^A-Za-z ]', '', 'g'), ' ', '')) AS c, regexp_replace({SEQ}, '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g') AS r FROM documents)
SELECT doc_id, length(c)::INT AS n_clean, length(r)::INT AS n_restricted, regexp_full_match(c, '{AA}+') AS valid, regexp_full_match(r, '{AA}+') AS restricted_valid FROM c""",
    "validity_reason": f"""WITH q AS (SELECT doc_id, {SEQ} AS s FROM documents), p AS (SELECT doc_id, regexp_replace(s, '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g') AS s FROM q), {RUNS.format('q')}, {RUNS.format('p').replace('runs AS', 'pruns AS')}
SELECT doc_id, CASE WHEN NOT regexp_full_match(p.s, '{AA}+') THEN 'alphabet' WHEN length(p.s) < 200 THEN 'short' WHEN length(p.s) > 2000 THEN 'long' WHEN pruns.run > 3 THEN 'run' ELSE 'ok' END AS reason, coalesce(runs.run, 0) AS run
FROM q JOIN p USING (doc_id) LEFT JOIN runs USING (doc_id) LEFT JOIN pruns USING (doc_id)""",
    "composition_charge": f"""WITH q AS (SELECT doc_id, {SEQ} AS s FROM documents)
SELECT doc_id, length(s)::INT AS n, ({_count('KRH')} - {_count('DE')})::INT AS charge, {_count('C')}::INT AS n_cys, round({_count('AVILMFWY')}::DOUBLE / nullif(length(s), 0), 6) AS hydrophobic,
 round(CASE WHEN length(s) > 0 THEN ({' + '.join(f"{_count(k)} * ({v})::DOUBLE" for k, v in S.HYDROPATHY.items())}) / length(s) END, 6) AS hydropathy FROM q""",
    "kmer_entropy": f"""WITH q AS (SELECT doc_id, {SEQ} AS s FROM documents), k AS (SELECT doc_id, s[i:i+1] AS k FROM (SELECT doc_id, s, unnest(range(1, length(s))) AS i FROM q)),
c AS (SELECT doc_id, k, count(*) AS n FROM k GROUP BY ALL), t AS (SELECT doc_id, sum(n) AS t, count(*) AS n_kmers FROM c GROUP BY doc_id)
SELECT doc_id, n_kmers, round(-sum(n / t * ln(n / t + 1e-9)), 6) AS entropy FROM c JOIN t USING (doc_id) GROUP BY doc_id, n_kmers""",
    "window_rules": f"""WITH q AS (SELECT doc_id, {SEQ} AS s FROM documents), p AS (SELECT *, s[1:60] AS a, s[61:120] AS b, s[1:80] AS c, s[10:30] AS e FROM q), {RUNS.format('q')}
SELECT doc_id, regexp_matches(s, 'TH.R|ING') AND NOT regexp_matches(s, 'XYZ|QQ') AS regex_ok,
 {_count('AEIO').replace('(s)', '(a)').replace('(s,', '(a,')} >= 10 AND {_count('ST').replace('(s)', '(b)').replace('(s,', '(b,')} >= 5 AS count_ok,
 ({_count('KRH').replace('(s)', '(c)').replace('(s,', '(c,')} - {_count('DE').replace('(s)', '(c)').replace('(s,', '(c,')}) BETWEEN -8 AND 8 AND ({_count('KRH').replace('(s)', '(e)').replace('(s,', '(e,')} - {_count('DE').replace('(s)', '(e)').replace('(s,', '(e,')}) <= 2 AS charge_ok,
 (greatest(0, {_count('C')} - 10) + greatest(0, -5 - ({_count('KRH')} - {_count('DE')})) + greatest(0, {_count('KRH')} - {_count('DE')} - 5) + greatest(0, coalesce(run, 0) - 3) + contains(s, 'THE')::INT + contains(s, 'ZZ')::INT)::BIGINT AS penalty
FROM p LEFT JOIN runs USING (doc_id)""",
    "interval_merge": INTERVALS + """, b AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM i),
g AS (SELECT *, sum(CASE WHEN p IS NULL OR s > p THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM b)
SELECT k, min(s) AS s, max(e) AS e, count(*) AS n_merged FROM g GROUP BY k, g""",
    "interval_overlap_count": INTERVALS + """, j AS (SELECT k, o, min(s) AS s, max(e) AS e FROM i GROUP BY k, o)
SELECT a.o AS orderkey, count(*) AS n_overlaps, max(b.o) AS last_other FROM j a JOIN j b ON a.k = b.k AND a.o <> b.o AND a.s < b.e AND b.s < a.e GROUP BY a.o""",
    "lock_islands": """WITH x AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), y AS (SELECT *, l_partkey - row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS g FROM x)
SELECT l_suppkey, min(l_partkey) AS first, max(l_partkey) AS last, count(*) AS n FROM y GROUP BY l_suppkey, g""",
    "score_histogram": """WITH w AS (SELECT count(o_totalprice) AS t, avg(o_totalprice) AS mu, stddev_pop(o_totalprice) AS sigma FROM orders),
b AS (SELECT least(greatest(floor(o_totalprice / 5000.0), 0), 99)::BIGINT AS bucket, count(*) AS n FROM orders WHERE o_totalprice IS NOT NULL GROUP BY 1)
SELECT bucket, n, round(n / (t * 5000.0), 12) AS density, round(mu, 4) AS mu, round(sigma, 4) AS sigma FROM b, w""",
    "equal_shards": "SELECT doc_id, floor((row_number() OVER (ORDER BY doc_id) - 1) / greatest(1, ceil((SELECT count(*) FROM documents) / 7.0)))::BIGINT AS shard FROM documents",
    "lock_map": f"""WITH q AS (SELECT doc_id, {SEQ} AS s FROM documents), p AS (SELECT doc_id, unnest([2, 3, 4, 5, 6, 7, 8, 30, 31, 32]) AS i, s FROM q)
SELECT q.doc_id, coalesce(string_agg(p.s[i + 1], '' ORDER BY i) FILTER (i < length(p.s)), '') AS locked, coalesce(string_agg((CASE WHEN i < 6 THEN i ELSE i + 3 END)::VARCHAR, ',' ORDER BY i) FILTER (i < length(p.s)), '') AS moved,
 any_value(q.s[1:6] || 'xyz' || q.s[7:12]) AS inserted FROM q JOIN p USING (doc_id) GROUP BY q.doc_id""",
    "merged_spans": f"""WITH q AS (SELECT doc_id, {SEQ} AS s FROM documents), l AS (SELECT doc_id, unnest(range(0, length(s))) AS i, unnest(string_split(s, '')) AS c FROM q WHERE length(s) > 0),
w AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM l WHERE c IN ('W', 'V', 'K'))
SELECT q.doc_id, count(i) FILTER (i IS NOT NULL AND (p IS NULL OR i > p + 4)) AS n_spans, coalesce(sum(CASE WHEN i IS NULL THEN 0 WHEN p IS NULL OR i > p + 4 THEN 4 ELSE i - p END), 0)::BIGINT AS n_covered FROM q LEFT JOIN w USING (doc_id) GROUP BY q.doc_id""",
    "best_window": f"""WITH q AS (SELECT doc_id, {SEQ} AS t FROM documents), w AS (SELECT doc_id, start, t[start + 1:start + 40] AS s, len(list_filter(range(0, greatest(length(t), 1), 211), lambda p: p >= start AND p < start + 40)) AS overlap FROM (SELECT doc_id, t, unnest(range(0, greatest(length(t) - 40, 0) + 1, 20)) AS start FROM q)),
l AS (SELECT doc_id, start, s, unnest(range(1, length(s) + 1)) AS i, unnest(string_split(s, '')) AS c FROM w WHERE length(s) > 0), g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, start, c ORDER BY i) AS g FROM l),
r AS (SELECT doc_id, start, max(n) AS run FROM (SELECT doc_id, start, c, g, count(*) AS n FROM g GROUP BY ALL) GROUP BY ALL),
v AS (SELECT doc_id, start, overlap, CASE WHEN length(s) < 40 THEN 1e9::DOUBLE ELSE round(0.8::DOUBLE - {_count('FWY')} / 40.0::DOUBLE + 0.3::DOUBLE * ({_count('PG')} / 40.0::DOUBLE) + 0.3::DOUBLE * coalesce(run, 0) / 40.0::DOUBLE + 0.2::DOUBLE * greatest(0, {_count('DE')} - {_count('KRH')}), 6) END AS score FROM w LEFT JOIN r USING (doc_id, start))
SELECT doc_id, overlap::BIGINT AS overlap, score, start::BIGINT AS start FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY overlap, score, start) AS rn FROM v) WHERE rn = 1""",
}
