"""Queries over ordered classes, hits with windows, pools that stop early, snippets and identity rewards."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ranking
from ..sources.tables import table
from .evaluation import SEQ, sequences

# Ordered rules; the first that matches names the class. Word ends are kept apart from signs.
CLASSES = [("metal", r"(?i)(^|[^a-z])(mg|zn|fe)(2\+|[^a-z]|$)"), ("nucleotide", r"(?i)(^|[^a-z])(atp|gtp|nad)([^a-z]|$)"), ("article", r"(?i)(^|[^a-z])(the|der|une|los)([^a-z]|$)"), ("marked", r"[$%&#]")]


def ordered_classes(spark, d):
    text, out = F.coalesce("text", F.lit("")), None
    for name, rule in CLASSES:
        hit = text.rlike(rule)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return table(spark, d, "documents").select("doc_id", out.otherwise("").alias("class"))


def hit_windows(spark, d):
    """The five longest runs of vowels of each sequence, each widened to 12 letters around its middle within the sequence."""
    s = sequences(spark, d)
    letters = s.select("doc_id", F.length("seq").alias("n"), F.posexplode(F.split("seq", "")).alias("i", "c")).filter(F.col("c").isin("A", "E", "I", "O", "U"))
    run = F.col("i") - F.row_number().over(Window.partitionBy("doc_id").orderBy("i"))
    runs = letters.withColumn("g", run).groupBy("doc_id", "n", "g").agg(F.min("i").alias("s"), F.count("*").alias("len"))
    best = ranking.top_k(runs, ["doc_id"], 5, F.desc("len"), "s")
    width = F.greatest(F.lit(12), F.col("len"))
    start = F.greatest(F.lit(0), F.least(F.col("s") + F.floor(F.col("len") / 2) - F.floor(width / 2), F.col("n") - width))
    return best.select("doc_id", F.col("rank").cast("long").alias("rank"), F.col("s").cast("long").alias("hit"), "len", start.cast("long").alias("first"), F.least(F.col("n").cast("long"), start + width).alias("last"))


def early_stop_pool(spark, d):
    """Of each brand's parts, groups taken by size until 25 are in the pool, without repeats of a type."""
    p = table(spark, d, "part").select("p_brand", "p_size", "p_type", "p_partkey")
    once = ranking.keep_first(p, ["p_brand", "p_type"], "p_size", "p_partkey")
    return ranking.top_k(once, ["p_brand"], 25, "p_size", "p_type").select("p_brand", "p_size", "p_type", "p_partkey", F.col("rank").cast("long").alias("rank"))


def snippets(spark, d):
    """Each item's first match of a stated word with up to 20 characters at either side, the word in capitals."""
    b = table(spark, d, "benchmark").filter(F.contains(F.lower("text"), F.lit("the")))
    at = F.instr(F.lower("text"), "the")
    cut = F.substring("text", F.greatest(F.lit(1), at - 20), F.least(at - 1, F.lit(20)) + 23)
    return b.select("item_id", F.regexp_replace(cut, "(?i)the", "THE").alias("snippet"))


def reward_identity(spark, d):
    """Equal letters at equal places of a document and the next one, as a reward from -1 to 1; -1 without letters."""
    docs = table(spark, d, "documents").select("doc_id", T.letters(F.coalesce("text", F.lit(""))).alias("s"))
    both = docs.join(docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("s").alias("t")), "doc_id")
    same = F.aggregate(F.zip_with(F.split("s", ""), F.split("t", ""), lambda a, b: F.when((a == b) & (a != ""), 1).otherwise(0)), F.lit(0), lambda n, x: n + x)
    n = F.least(F.length("s"), F.length("t"))
    return both.select("doc_id", F.round(F.when(n > 0, 2 * same / n - 1).otherwise(-1.0), 6).alias("reward"))


QUERIES = {f.__name__: f for f in (ordered_classes, hit_windows, early_stop_pool, snippets, reward_identity)}

ORACLES = {
    "ordered_classes": "SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(coalesce(text, ''), '{r}') THEN '{n}'" for n, r in CLASSES) + " ELSE '' END AS class FROM documents",
    "hit_windows": f"""WITH q AS (SELECT doc_id, {SEQ} AS s FROM documents), l AS (SELECT doc_id, length(s) AS n, unnest(range(0, length(s))) AS i, unnest(string_split(s, '')) AS c FROM q WHERE length(s) > 0),
v AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM l WHERE c IN ('A', 'E', 'I', 'O', 'U')), r AS (SELECT doc_id, n, min(i) AS s, count(*) AS len FROM v GROUP BY doc_id, n, g),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY len DESC, s) AS rank, greatest(12, len) AS w FROM r), f AS (SELECT *, greatest(0, least(s + len // 2 - w // 2, n - w)) AS first FROM k WHERE rank <= 5)
SELECT doc_id, rank, s AS hit, len, first, least(n, first + w) AS last FROM f""",
    "early_stop_pool": """WITH o AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_size, p_partkey) AS rn FROM part), k AS (SELECT p_brand, p_size, p_type, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_type) AS rank FROM o WHERE rn = 1) SELECT * FROM k WHERE rank <= 25""",
    "snippets": """WITH b AS (SELECT item_id, text, instr(lower(text), 'the') AS p FROM benchmark WHERE contains(lower(text), 'the'))
SELECT item_id, regexp_replace(substring(text, greatest(1, p - 20), least(p - 1, 20) + 23), 'the', 'THE', 'gi') AS snippet FROM b""",
    "reward_identity": """WITH s AS (SELECT doc_id, upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) AS s FROM documents), b AS (SELECT a.doc_id, string_split(a.s, '') AS x, string_split(b.s, '') AS y, least(length(a.s), length(b.s)) AS n FROM s a JOIN s b ON b.doc_id = a.doc_id + 1)
SELECT doc_id, round(CASE WHEN n > 0 THEN 2 * len(list_filter(list_zip(x[1:n], y[1:n]), lambda p: p[1] = p[2])) / n - 1 ELSE -1.0::DOUBLE END, 6) AS reward FROM b""",
}
