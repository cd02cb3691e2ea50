"""An inverted index with positions over several weighted fields: stems, phrases, and/or, BM25F.

The index is a table (term, field, doc, positions, n) in the shared folder. Each task that reads texts writes its own documents'
postings in the order of the terms: nothing is shuffled, a frequent term lies in as many files as there are tasks, and the
statistics of the row groups say which terms they hold. Queries are a table
too, of any number. A query's clauses must all match, one alternative of a clause is enough, an alternative of several terms
is a phrase in one field. The documents to look at come from each query's rarest clause, and of a phrase from
its rarest term, so a frequent term is only ever asked for in documents that something rarer has found.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import stem, stemmed, tokens
from ..sources.tables import shared_folder
from .ranking import top_k

POSTINGS = "term string, field string, doc long, positions array<int>, n int"
#: Distinct query terms that are broadcast; more are joined by a shuffle, frequent terms over SALTS parts.
TERMS, SALTS = 100_000, 64
_WORD = re.compile("[a-z0-9_-]+")


def _rows(batches: Iterator[pa.RecordBatch], fields: list[str]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in POSTINGS.split(", ")]
    stems: dict[str, str] = {}
    for b in batches:
        for k in range(0, b.num_rows, 64):
            if len(stems) > 500_000:
                stems.clear()
            part = b.slice(k, 64)
            out: list[list] = [[], [], [], [], []]
            texts = [part.column(f"t{i}").to_pylist() for i in range(len(fields))]
            for at, doc in enumerate(part.column("doc").to_pylist()):
                for field, column in zip(fields, texts, strict=True):
                    words = _WORD.findall(column[at] or "")
                    places: dict[str, list[int]] = {}
                    for p, w in enumerate(words):
                        places.setdefault(stems.get(w) or stems.setdefault(w, stemmed(w)), []).append(p)
                    for w, p in places.items():
                        for to, x in zip(out, (w, field, doc, p, len(words)), strict=True):
                            to.append(x)
            kinds = (pa.string(), pa.string(), pa.int64(), pa.list_(pa.int32()), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=names)


def build(docs: DataFrame, key: str, fields: dict[str, Column], path: str) -> DataFrame:
    """Writes the postings of docs under path and reads them again. Ids must be filled and unique."""
    texts = [F.lower(c).alias(f"t{i}") for i, c in enumerate(fields.values())]
    names = list(fields)
    rows = docs.select(F.col(key).cast("long").alias("doc"), *texts).mapInArrow(lambda b: _rows(b, names), POSTINGS)
    rows.sortWithinPartitions("term", "doc").write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(f"{path}/postings")
    lengths = docs.select(*[F.size(tokens(F.coalesce(c, F.lit("")))).cast("long").alias(f) for f, c in fields.items()])
    lengths.agg(F.count("*").alias("docs"), *[F.avg(f).alias(f) for f in names]).write.mode("overwrite").parquet(f"{path}/sizes")
    return docs.sparkSession.read.parquet(f"{path}/postings")


def parsed(queries: DataFrame, query: str, keywords: str) -> DataFrame:
    """query, clause, alt, nth, term, m: the terms of an array of keywords; a bar in a keyword means or, several words mean a phrase.

    Keywords and alternatives without a word ask for nothing.
    """
    clauses = queries.select(F.col(query).alias("query"), F.posexplode(keywords).alias("clause", "keyword"))
    alts = clauses.select("query", "clause", F.posexplode(F.split("keyword", r"\|")).alias("alt", "phrase"))
    terms = F.transform(tokens(F.col("phrase")), stem)
    return alts.withColumn("terms", terms).select("query", "clause", "alt", F.size("terms").alias("m"), F.posexplode("terms").alias("nth", "term"))


def of_terms(postings: DataFrame, wanted: DataFrame) -> DataFrame:
    """postings joined with wanted on term; the few wanted rows are broadcast, of many each goes to SALTS parts of its term."""
    n = wanted.count()
    if n <= TERMS:
        return postings.join(F.broadcast(wanted), "term")
    salted = wanted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return postings.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int")).join(salted, ["term", "salt"]).drop("salt")


def search(path: str, wanted: DataFrame, weights: dict[str, float], k: int, k1: float = 1.5, b: float = 0.75, digits: int = 6) -> DataFrame:
    """query, doc, score, rank of the k best documents for each query of parsed terms.

    BM25F: of an alternative, each field's count is weighted and divided by 1 - b + b * length / mean length, their sum t
    gives idf * t * (k1 + 1) / (t + k1); idf is ln(1 + (N - df + 0.5) / (df + 0.5)), of a phrase the sum of its terms'.
    A document's score is the sum over the alternatives that occur in it.
    """
    spark = wanted.sparkSession
    postings = spark.read.parquet(f"{path}/postings")
    sizes = spark.read.parquet(f"{path}/sizes").first()
    postings = of_terms(postings, wanted.select("term").distinct())  # from here on only the queries' terms
    df_ = postings.select("term", "doc").distinct().groupBy("term").agg(F.count("*").alias("df"))
    known = wanted.join(df_, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    # The queries' terms with their frequencies are used four times: written once.
    asked_for = shared_folder(spark, "asked")
    known.write.parquet(asked_for)
    known = spark.read.schema(known.schema).parquet(asked_for)
    idf = F.log(1 + (F.lit(float(sizes["docs"])) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    alts = known.groupBy("query", "clause", "alt").agg(F.sum(idf).alias("idf"), F.min("df").alias("least"), F.min_by("term", F.struct("df", "nth")).alias("lead"))
    cost = alts.groupBy("query", "clause").agg(F.sum("least").alias("cost"))
    rarest = cost.groupBy("query").agg(F.min_by("clause", F.struct("cost", "clause")).alias("clause"), F.count("*").alias("clauses"))
    leads = alts.filter("least > 0").join(rarest, ["query", "clause"]).select("query", F.col("lead").alias("term")).distinct()
    found = of_terms(postings.select("term", "doc"), leads).select("query", "doc").distinct()
    possible = known.join(alts.filter("least > 0").select("query", "clause", "alt", "idf"), ["query", "clause", "alt"])
    asked = found.join(possible.select("query", "clause", "alt", "nth", "m", "term", "idf"), "query")
    hits = postings.join(asked, ["term", "doc"])
    starts = F.transform("positions", lambda p: p - F.col("nth"))
    runs = hits.groupBy("query", "clause", "alt", "doc", "field").agg(F.first("m").alias("m"), F.first("n").alias("n"), F.first("idf").alias("idf"), F.collect_list(starts).alias("starts"))
    both = F.aggregate(F.slice("starts", 2, F.greatest(F.size("starts") - 1, F.lit(1))), F.element_at("starts", 1), lambda x, y: F.array_intersect(x, y))
    tf = F.when(F.col("m") == 1, F.size(F.element_at("starts", 1))).otherwise(F.size(both))
    matched = runs.filter("size(starts) = m").withColumn("tf", tf).filter("tf > 0")
    weight, mean = F.lit(0.0), F.lit(1.0)
    for f, w in weights.items():
        weight, mean = F.when(F.col("field") == f, w).otherwise(weight), F.when(F.col("field") == f, sizes[f]).otherwise(mean)
    share = weight * F.col("tf") / (1 - b + b * F.col("n") / mean)
    each = matched.groupBy("query", "clause", "alt", "doc").agg(F.sum(share).alias("t"), F.first("idf").alias("idf")).filter("t > 0")
    scored = each.groupBy("query", "doc").agg(F.sum(F.col("idf") * F.col("t") * (k1 + 1) / (F.col("t") + k1)).alias("score"), F.countDistinct("clause").alias("had"))
    whole = scored.join(rarest.select("query", "clauses"), "query").filter("had = clauses")
    return top_k(whole.select("query", "doc", F.round("score", digits).alias("score")), ["query"], k, F.desc("score"), "doc")
