"""Text search: bags of words, BM25, cascades of ever looser queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from .ranking import first_level, top_k


def term_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, tf."""
    return docs.select(key, F.explode(tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def bag_cosine(docs: DataFrame, key: str, queries: DataFrame, query: str, text: str) -> DataFrame:
    """key, query, score > 0: cosine of token counts. Only shared terms meet, as an equi-join on the term."""
    a, b = term_counts(docs, key, text), term_counts(queries, query, text)
    size = lambda df, k, name: df.groupBy(k).agg(F.sqrt(F.sum(F.col("tf") * F.col("tf")).cast("double")).alias(name))
    shared = a.join(b.select(query, "term", F.col("tf").alias("qtf")), "term").groupBy(key, query).agg(F.sum(F.col("tf") * F.col("qtf")).alias("shared"))
    return shared.join(size(a, key, "na"), key).join(size(b, query, "nb"), query).select(key, query, (F.col("shared") / (F.col("na") * F.col("nb"))).alias("score"))


def bm25(docs: DataFrame, key: str, queries: DataFrame, query: str, text: str, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """key, query, score of Okapi BM25 with idf = ln(1 + (N - df + 0.5) / (df + 0.5)); each query term counts once."""
    tf = term_counts(docs, key, text)
    terms = term_counts(queries, query, text).select(query, "term")
    found = tf.join(terms.select("term").distinct(), "term", "left_semi")
    df_ = found.groupBy("term").agg(F.count("*").alias("df"))
    size = docs.select(key, F.size(tokens(F.col(text))).alias("dl"))
    whole = size.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    weight = found.join(df_, "term").join(size, key).join(F.broadcast(whole))  # whole is one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    gain = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return weight.select(key, "term", gain.alias("gain")).join(terms, "term").groupBy(key, query).agg(F.sum("gain").alias("score"))


def best_matches(scored: DataFrame, key: str, query: str, k: int, digits: int = 6) -> DataFrame:
    """The k best keys of each query by the rounded score."""
    return top_k(scored.withColumn("score", F.round("score", digits)), [query], k, F.desc("score"), key)


def overlap_score(text_tokens: Column, query_tokens: Column, text: Column, phrase: Column) -> Column:
    """5 if the phrase occurs, and 1 for each occurrence of a query token."""
    hits = F.size(F.filter(text_tokens, lambda t: F.array_contains(query_tokens, t)))
    return F.when(F.contains(F.lower(text), F.lower(phrase)), 5).otherwise(0) + hits


def relaxed(terms: Column) -> Column:
    """Query variants from strict to loose: all terms, each pair of neighbours, each term; level 1 is the strictest."""
    n = F.size(terms)
    pairs = F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.struct(F.lit(2).alias("level"), F.slice(terms, i, F.lit(2)).alias("terms"))))
    single = F.transform(terms, lambda t: F.struct(F.lit(3).alias("level"), F.array(t).alias("terms")))
    return F.concat(F.array(F.struct(F.lit(1).alias("level"), terms.alias("terms"))), F.coalesce(pairs, F.slice(single, 1, 0)), single)


def cascade(docs: DataFrame, key: str, queries: DataFrame, query: str, text: str) -> DataFrame:
    """query, key, level of all documents that hold every term of a variant of the strictest level that finds any.

    A document meets a query through shared terms only, and only documents that share one are tested.
    """
    variants = queries.select(query, F.posexplode(relaxed(F.array_distinct(tokens(F.col(text))))).alias("variant", "v")).select(query, "variant", "v.level", F.col("v.terms").alias("terms"))
    wanted = variants.withColumn("need", F.size("terms")).withColumn("term", F.explode("terms"))
    have = docs.select(key, F.explode(F.array_distinct(tokens(F.col(text)))).alias("term"))
    met = have.join(wanted, "term").groupBy(query, "variant", "level", "need", key).agg(F.count("*").alias("found")).filter("found = need")
    return first_level(met.select(query, key, "level").distinct(), [query], "level")
