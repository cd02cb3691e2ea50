"""Queries over embeddings and free text: nearest rows, ranking quality, text search, similarity functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vector as V
from ..operators import lookups, postings, ranking, retrieval, search
from ..operators import sequences as Q
from ..sources.tables import shared_folder, table


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def asked(df, key):
    """The stated set of queries: every row whose id is divisible by 100, against all rows."""
    return df.filter(F.col(key) % 100 == 0)


def knn_topk(spark, d):
    v = vectors(spark, d)
    best = retrieval.nearest(asked(v, "id"), v, 10)
    return best.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def pairwise_score(spark, d):
    """Each row with the next one."""
    v = vectors(spark, d)
    n = v.select((F.col("id") - 1).alias("id"), F.col("vector").alias("next"))
    return v.join(n, "id").select("id", F.round(V.dot(F.col("vector"), F.col("next")), 6).alias("dot"), F.round(V.cosine(F.col("vector"), F.col("next")), 6).alias("cosine"))


def quality(spark, d):
    """How well each stated query ranks the rows of its own label among all others."""
    v = vectors(spark, d).withColumnRenamed("label", "kind")
    return retrieval.quality_by_counts(asked(v, "id"), v)


def retrieval_map_mrr_auc(spark, d):
    return quality(spark, d).select("query_id", *[F.round(c, 6).alias(c) for c in ("ap", "mrr", "auc")], "n_relevant")


def macro_level_mean(spark, d):
    labelled = quality(spark, d).join(vectors(spark, d).select(F.col("id").alias("query_id"), "label"), "query_id")
    levels = labelled.select("label").distinct().withColumn("level", F.explode(F.when(F.col("label") % 2 == 0, F.array(F.lit("even"), F.lit("all"))).otherwise(F.array(F.lit("odd"), F.lit("all")))))
    m = retrieval.macro_mean(labelled, levels, "label", ["ap", "mrr"])
    return m.select("level", F.round("ap", 6).alias("ap"), F.round("mrr", 6).alias("mrr"), "n_groups")


def inverted_file_topk(spark, d):
    """The stated queries against an index over all rows; held against knn_topk in the tests."""
    v, path = vectors(spark, d), shared_folder(spark, "inverted")
    retrieval.inverted_file(v, path)
    found = retrieval.probe(asked(v, "id"), path, 10, probes=32)
    return found.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def negative_sample_hit(spark, d):
    """A query's own vector against 31 drawn ones: does it score best? The draw is a seeded order, alike for any partitions."""
    v = vectors(spark, d)
    q = asked(v, "id").select(F.col("id").alias("query_id"), "id")
    drawn = lookups.negatives(q, v.select("id"), "query_id", "id", 31, seed=3)
    other = v.select(F.col("id").alias("negative"), F.col("vector").alias("other"))
    mine = v.select(F.col("id").alias("query_id"), "vector")
    scored = drawn.join(mine, "query_id").join(other, "negative").withColumn("score", V.dot(F.col("vector"), F.col("other")))
    best = scored.groupBy("query_id").agg(F.count("*").alias("n"), F.countDistinct("negative").alias("n_distinct"), F.max("score").alias("best"), F.max((F.col("negative") == F.col("query_id")).cast("int")).alias("self"))
    return best.join(mine, "query_id").select("query_id", "n", "n_distinct", "self", (V.dot(F.col("vector"), F.col("vector")) > F.col("best")).alias("hit"))


def token_cosine(spark, d):
    docs, items = table(spark, d, "documents"), table(spark, d, "benchmark").select("item_id", "text")
    return search.best_matches(search.bag_cosine(docs, "doc_id", asked(items, "item_id"), "item_id", "text"), "doc_id", "item_id", 5).select("item_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


def bm25_topk(spark, d):
    docs, items = table(spark, d, "documents"), table(spark, d, "benchmark").select("item_id", "text")
    return search.best_matches(search.bm25(docs, "doc_id", asked(items, "item_id"), "item_id", "text"), "doc_id", "item_id", 10).select("item_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


def item_keywords(text):
    """Any two neighbouring words of an item as a phrase, and one of three frequent terms."""
    t = T.tokens(text)
    pairs = F.zip_with(t, F.slice(t, F.lit(2), F.size(t)), lambda a, b: F.when(b.isNotNull(), F.concat_ws(" ", a, b)))
    return F.array(F.concat_ws("|", F.array_compact(pairs)), F.lit("src3|the|Ways of"))


def fielded_search(spark, d):
    """The stated items' neighbouring words in texts, and sources or frequent words beside them."""
    docs, path = table(spark, d, "documents").select("doc_id", "text", "source"), shared_folder(spark, "postings")
    postings.build(docs, "doc_id", {"text": F.col("text"), "source": F.col("source")}, path)
    items = asked(table(spark, d, "benchmark"), "item_id").select("item_id", item_keywords(F.coalesce("text", F.lit(""))).alias("keywords"))
    found = postings.search(path, postings.parsed(items, "item_id", "keywords"), {"text": 1.0, "source": 2.0}, 10)
    return found.select(F.col("query").alias("item_id"), F.col("doc").alias("doc_id"), "score", F.col("rank").cast("long").alias("rank"))


def substring_token_score(spark, d):
    """All texts against one stated phrase."""
    text, phrase = F.coalesce("text", F.lit("")), F.lit("the thing")
    return table(spark, d, "documents").select("doc_id", search.overlap_score(T.tokens(text), F.split(phrase, " "), text, phrase).cast("long").alias("score"))


def keyword_filter(spark, d):
    return table(spark, d, "documents").filter(T.keyword_match(F.coalesce("text", F.lit("")), 'the|une "of the" ing')).select("doc_id", "lang")


def query_cascade(spark, d):
    """Documents with the words of the stated items: all of them, else two neighbours, else any."""
    items = asked(table(spark, d, "benchmark"), "item_id").select("item_id", "text")
    return search.cascade(table(spark, d, "documents"), "doc_id", items, "item_id", "text").select("item_id", "doc_id", F.col("level").cast("long").alias("level"))


def prefix_identity(spark, d):
    """Equal letters at equal places of neighbouring documents over the shorter length."""
    docs = table(spark, d, "documents").select("doc_id", T.letters(F.coalesce("text", F.lit(""))).alias("s"))
    both = docs.join(docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("s").alias("t")), "doc_id").filter("length(s) > 0 and length(t) > 0")
    same = F.aggregate(F.zip_with(F.split("s", ""), F.split("t", ""), lambda a, b: F.when(a == b, 1).otherwise(0)), F.lit(0), lambda n, x: n + x)
    return both.select("doc_id", F.round(same / F.least(F.length("s"), F.length("t")), 6).alias("identity"))


def repeat_fraction(spark, d):
    docs = table(spark, d, "documents").select("doc_id", T.letters(F.coalesce("text", F.lit(""))).alias("s"))
    return docs.select("doc_id", F.round(Q.repeat_fraction("s"), 6).alias("repeat"))


def page_links(spark, d):
    p = table(spark, d, "pages")
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    return p.select("page_id", F.explode(links).alias("link")).groupBy("link").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("n_pages"))


def item_fuzzy_ratio(spark, d):
    """The names of customers against those of the next ones."""
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_name")
    n = c.select((F.col("c_custkey") - 1).alias("c_custkey"), F.col("c_mktsegment").alias("s2"), F.col("c_name").alias("n2"))
    return c.join(n, "c_custkey").select("c_custkey", F.round(Q.fuzzy_ratio(F.col("c_mktsegment"), F.col("s2")), 6).alias("ratio"), F.round(Q.local_identity(F.col("c_name"), F.col("n2")), 6).alias("identity"))


QUERIES = {f.__name__: f for f in (knn_topk, pairwise_score, retrieval_map_mrr_auc, macro_level_mean, inverted_file_topk, negative_sample_hit, token_cosine, bm25_topk, fielded_search, substring_token_score, keyword_filter, query_cascade, prefix_identity, repeat_fraction, page_links, item_fuzzy_ratio)}

RANKED = """v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x, label FROM embeddings), r AS (SELECT q.id AS query_id, q.label AS ql, v.id, v.label = q.label AS relevant, list_dot_product(q.x, v.x) AS score,
 row_number() OVER (PARTITION BY q.id ORDER BY list_dot_product(q.x, v.x) DESC, v.id) AS rank, q.label AS label FROM v q JOIN v ON q.id % 100 = 0 AND v.id <> q.id)"""
QUALITY = """n AS (SELECT *, row_number() OVER (PARTITION BY query_id, relevant ORDER BY rank) AS nth FROM r), g AS (SELECT query_id, any_value(ql) AS label, coalesce(avg(nth / rank) FILTER (relevant), 0) AS ap, coalesce(1.0::DOUBLE / min(rank) FILTER (relevant), 0) AS mrr, count(*) FILTER (relevant) AS p, count(*) AS a, coalesce(sum(rank) FILTER (relevant), 0) AS s FROM n GROUP BY query_id)"""
TERMS = """dt AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_-]+')) AS t FROM documents) GROUP BY ALL), qt AS (SELECT item_id, t, count(*) AS tf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_-]+')) AS t FROM benchmark WHERE item_id % 100 = 0) GROUP BY ALL)"""

STEM_ONE = r"(CASE WHEN regexp_matches(x, '[^ae]ies$') AND length(x) > 4 THEN regexp_replace(x, 'ies$', 'y') WHEN regexp_matches(x, '(ss|x|ch|sh)es$') THEN regexp_replace(x, 'es$', '') WHEN regexp_matches(x, '[^su]s$') AND length(x) > 3 THEN regexp_replace(x, 's$', '') ELSE x END)"
STEM = "(CASE WHEN regexp_matches(y, '^[a-z]{3,}(ing|ed)$') AND regexp_matches(y, '[aeiouy].*(ing|ed)$') THEN regexp_replace(y, '(ing|ed)$', '') ELSE y END)"

ORACLES = {
    "fielded_search": f"""WITH f AS (SELECT doc_id, 'text' AS field, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_-]+') AS t FROM documents UNION ALL SELECT doc_id, 'source', regexp_extract_all(lower(coalesce(source, '')), '[a-z0-9_-]+') FROM documents),
v AS (SELECT x, {STEM.replace("y,", STEM_ONE + ",").replace("ELSE y", "ELSE " + STEM_ONE)} AS term FROM (SELECT DISTINCT unnest(t) AS x FROM f UNION SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9_-]+')) FROM benchmark UNION SELECT unnest(['src3', 'the', 'ways', 'of']))),
w AS (SELECT doc_id, field, n, pos, term FROM (SELECT doc_id, field, len(t) AS n, unnest(t) AS x, unnest(range(len(t))) AS pos FROM f) JOIN v USING (x)),
a AS (SELECT field, avg(len(t)) AS mean FROM f GROUP BY field), s AS (SELECT count(*) AS docs FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_-]+') AS t FROM benchmark WHERE item_id % 100 = 0),
p AS (SELECT item_id, 0 AS clause, alt, nth, 2 AS m, x FROM (SELECT item_id, unnest(range(1, len(t))) AS alt, t FROM i), (SELECT unnest([0, 1]) AS nth), LATERAL (SELECT t[alt + nth] AS x) UNION ALL SELECT item_id, 1, c.alt, c.nth, c.m, c.x FROM i, (VALUES (0, 0, 1, 'src3'), (1, 0, 1, 'the'), (2, 0, 2, 'ways'), (2, 1, 2, 'of')) c(alt, nth, m, x)),
q AS (SELECT item_id, clause, alt, nth, m, term FROM p JOIN v USING (x)),
df AS (SELECT term, count(DISTINCT doc_id) AS df FROM w WHERE term IN (SELECT term FROM q) GROUP BY term),
idf AS (SELECT item_id, clause, alt, sum(ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))) AS idf FROM q JOIN df USING (term), s GROUP BY ALL),
h AS (SELECT item_id, clause, alt, m, doc_id, field, n, pos - nth AS start FROM q JOIN w USING (term) GROUP BY ALL HAVING count(DISTINCT nth) = m),
tf AS (SELECT item_id, clause, alt, doc_id, field, n, count(*) AS tf FROM h GROUP BY ALL),
t AS (SELECT item_id, clause, alt, doc_id, sum(CASE field WHEN 'text' THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END * tf / (0.25::DOUBLE + 0.75::DOUBLE * n / mean)) AS t FROM tf JOIN a USING (field) GROUP BY ALL),
g AS (SELECT item_id, doc_id, round(sum(idf * t * 2.5::DOUBLE / (t + 1.5::DOUBLE)), 6) AS score, count(DISTINCT clause) AS had FROM t JOIN idf USING (item_id, clause, alt) GROUP BY ALL),
c AS (SELECT item_id, count(DISTINCT clause) AS clauses FROM q GROUP BY item_id),
y AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM g JOIN c USING (item_id) WHERE had = clauses) SELECT * FROM y WHERE rank <= 10""",
    "negative_sample_hit": """WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x FROM embeddings), t AS (SELECT count(*) AS n FROM v), h AS (SELECT id, ('0x' || md5(id || '|3')[1:15])::BIGINT AS h FROM v), p AS (SELECT id AS negative, row_number() OVER (ORDER BY h) - 1 AS place FROM h),
w AS (SELECT id AS query_id, x, unnest(range(0, 36)) AS try, ('0x' || md5(id || '|4')[1:15])::BIGINT % n AS start FROM v, t WHERE id % 100 = 0),
f AS (SELECT query_id, x, negative, row_number() OVER (PARTITION BY query_id ORDER BY try) AS rank FROM w, t JOIN p ON place = (start + try) % n WHERE negative <> query_id),
s AS (SELECT query_id, any_value(f.x) AS x, count(*) AS n, count(DISTINCT negative) AS n_distinct, max(list_dot_product(f.x, v.x)) AS best FROM f JOIN v ON v.id = negative WHERE rank <= 31 GROUP BY query_id)
SELECT query_id, n, n_distinct, 0 AS self, list_dot_product(x, x) > best AS hit FROM s""",
    "repeat_fraction": """WITH q AS (SELECT doc_id, upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) AS s FROM documents), l AS (SELECT doc_id, i, c, n FROM (SELECT doc_id, length(s) AS n, unnest(range(1, length(s) + 1)) AS i, unnest(string_split(s, '')) AS c FROM q WHERE length(s) > 0)),
e AS (SELECT a.doc_id, k.w, a.i, a.i - row_number() OVER (PARTITION BY a.doc_id, k.w ORDER BY a.i) AS g FROM l a, (SELECT unnest(range(1, 21)) AS w) k JOIN l b ON b.doc_id = a.doc_id AND b.i = a.i + k.w AND b.c = a.c WHERE k.w <= a.n // 2),
r AS (SELECT doc_id, w, min(i) AS s, max(i) + w AS e FROM e GROUP BY doc_id, w, g HAVING count(*) >= 2 * w),
c AS (SELECT doc_id, count(DISTINCT p) AS k FROM (SELECT doc_id, unnest(range(s, e + 1)) AS p FROM r) GROUP BY doc_id)
SELECT doc_id, round(coalesce(k, 0) / greatest(length(s), 1), 6)::DOUBLE AS repeat FROM q LEFT JOIN c USING (doc_id)""",
    "knn_topk": f"WITH {RANKED} SELECT query_id, id, round(score, 6) AS score, rank FROM r WHERE rank <= 10",
    "pairwise_score": "SELECT a.vec_id AS id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS dot, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "retrieval_map_mrr_auc": f"WITH {RANKED}, {QUALITY} SELECT query_id, round(ap, 6) AS ap, round(mrr, 6) AS mrr, round(CASE WHEN p > 0 AND a > p THEN (p * (a - p) - (s - p * (p + 1) / 2)) / (p * (a - p)) ELSE 0 END, 6)::DOUBLE AS auc, p AS n_relevant FROM g",
    "macro_level_mean": f"""WITH {RANKED}, {QUALITY}, b AS (SELECT label, avg(ap) AS ap, avg(mrr) AS mrr FROM g GROUP BY label), l AS (SELECT *, 'all' AS level FROM b UNION ALL SELECT *, CASE WHEN label % 2 = 0 THEN 'even' ELSE 'odd' END FROM b)
SELECT level, round(avg(ap), 6) AS ap, round(avg(mrr), 6) AS mrr, count(*) AS n_groups FROM l GROUP BY level""",
    "token_cosine": f"""WITH {TERMS}, s AS (SELECT item_id, doc_id, sum(dt.tf * qt.tf) AS d FROM dt JOIN qt USING (t) GROUP BY ALL), na AS (SELECT doc_id, sqrt(sum(tf * tf)::DOUBLE) AS n FROM dt GROUP BY ALL), nb AS (SELECT item_id, sqrt(sum(tf * tf)::DOUBLE) AS n FROM qt GROUP BY ALL),
x AS (SELECT item_id, doc_id, round(d / (na.n * nb.n), 6) AS score FROM s JOIN na USING (doc_id) JOIN nb USING (item_id)), y AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM x) SELECT * FROM y WHERE rank <= 5""",
    "bm25_topk": f"""WITH {TERMS}, df AS (SELECT t, count(*) AS df FROM dt GROUP BY t), dl AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9_-]+')) AS dl FROM documents), w AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
x AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * dt.tf * 2.5::DOUBLE / (dt.tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score FROM dt JOIN qt USING (t) JOIN df USING (t) JOIN dl USING (doc_id), w GROUP BY ALL),
y AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM x) SELECT * FROM y WHERE rank <= 10""",
    "substring_token_score": "SELECT doc_id, (CASE WHEN contains(lower(text), 'the thing') THEN 5 ELSE 0 END + len(list_filter(regexp_extract_all(lower(text), '[a-z0-9_-]+'), lambda t: t IN ('the', 'thing'))))::BIGINT AS score FROM documents",
    "keyword_filter": "SELECT doc_id, lang FROM documents WHERE (contains(lower(text), 'the') OR contains(lower(text), 'une')) AND contains(lower(text), 'of the') AND contains(lower(text), 'ing')",
    "query_cascade": """WITH q AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_-]+')) AS x, regexp_extract_all(lower(text), '[a-z0-9_-]+') AS y FROM benchmark WHERE item_id % 100 = 0), o AS (SELECT item_id, list_filter(y, lambda v, i: list_position(y, v) = i) AS t FROM q),
v AS (SELECT item_id, 1 AS level, t AS terms FROM o UNION ALL SELECT item_id, 2, t[i:i + 1] FROM (SELECT item_id, t, unnest(range(1, len(t))) AS i FROM o) UNION ALL SELECT item_id, 3, [unnest(t)] FROM o),
d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_-]+')) AS w FROM documents), m AS (SELECT DISTINCT item_id, doc_id, level FROM v JOIN d ON list_has_all(w, terms)), b AS (SELECT item_id, min(level) AS level FROM m GROUP BY item_id)
SELECT item_id, doc_id, level::BIGINT AS level FROM m JOIN b USING (item_id, level)""",
    "prefix_identity": """WITH s AS (SELECT doc_id, upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) AS s FROM documents), b AS (SELECT a.doc_id, string_split(a.s, '') AS x, string_split(b.s, '') AS y, least(length(a.s), length(b.s)) AS n FROM s a JOIN s b ON b.doc_id = a.doc_id + 1 WHERE length(a.s) > 0 AND length(b.s) > 0)
SELECT doc_id, round(len(list_filter(list_zip(x[1:n], y[1:n]), lambda p: p[1] = p[2])) / n, 6) AS identity FROM b""",
    "page_links": "SELECT link, count(*) AS n, count(DISTINCT page_id) AS n_pages FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS link FROM pages) GROUP BY link",
}
