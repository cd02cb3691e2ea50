"""Rounds over a session's state: scoring it again, applying constraints of which some fail, and ranking in two phases.

The state of a session is its ranked rows: session, accession, sequence, score, place, the best score first and of equal scores the
smaller place. Every cut keeps k rows of a session below the shuffle, and pools are made distinct before they meet
a session, so a session that holds a third of all rows is no large group. What fails is data: an attempt gives each row a
fragment or an error, and a round keeps both lists.

Defined results: rows without a session are left out; rows without an accession or a sequence take up their place among
the k best but are not scored; of repeated pairs of accession and sequence the one ranked before stays, with its score; null scores rank last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import keep_first, top_k

SESSION, PAIR = ["session"], ["session", "accession", "sequence"]


def _filled(*columns: str) -> Column:
    out = F.col("session").isNotNull()
    for c in columns:
        out = out & (F.coalesce(F.length(c), F.lit(0)) > 0)
    return out


def _best(rows: DataFrame, k: int) -> DataFrame:
    return top_k(rows.filter(_filled()), SESSION, k, F.desc_nulls_last("score"), "place")


def to_score(ranked: DataFrame, pool: DataFrame, k: int) -> DataFrame:
    """session, accession, sequence, place, origin: the k best ranked rows of a session, or all its pool if it has none ranked; each pair once."""
    head = _best(ranked, k).filter(_filled("accession", "sequence")).groupBy(*PAIR).agg(F.min(F.col("rank").cast("long")).alias("place"))
    rest = pool.filter(_filled("accession", "sequence")).groupBy(*PAIR).agg(F.min("place").alias("place"))
    rest = rest.join(ranked.select("session").distinct(), "session", "left_anti")
    return head.withColumn("origin", F.lit("ranked")).unionByName(rest.withColumn("origin", F.lit("pool")))


def merged_ranks(ranked: DataFrame, scored: DataFrame, k: int) -> DataFrame:
    """session, accession, sequence, score, rank: the state after a round."""
    columns = [*PAIR, "score", "place"]
    both = ranked.filter(_filled()).select(*columns, F.lit(0).alias("new")).unionByName(scored.select(*columns, F.lit(1).alias("new")))
    once = keep_first(both, PAIR, "new", F.desc_nulls_last("score"), "place")
    return top_k(once, SESSION, k, F.desc_nulls_last("score"), "new", "place").select(*PAIR, "score", "rank")


def score_round(ranked: DataFrame, pool: DataFrame, k: int, scorer: Callable[[Column, Column], Column]) -> DataFrame:
    """For each session of either table: origin and number of what is scored, the best of it, and the best row of the state after it."""
    scored = to_score(ranked, pool, k).withColumn("score", scorer(F.col("accession"), F.col("sequence")))
    sessions = ranked.select("session").union(pool.select("session")).filter(_filled()).distinct()
    this = scored.groupBy("session").agg(F.max("origin").alias("origin"), F.count("*").alias("n_scored"), F.max("score").alias("best_round"))
    best = merged_ranks(ranked, scored, k).filter("rank = 1").drop("rank")
    out = sessions.join(this, "session", "left").join(best, "session", "left")
    # Without anything to score no best is told.
    told = {c: F.when(F.col("n_scored") > 0, F.col(c)) for c in ("accession", "sequence", "score")}
    return out.withColumns(told).withColumn("n_scored", F.coalesce("n_scored", F.lit(0)))


def constraint_round(ranked: DataFrame, k: int, attempt: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """For each session with ranked accessions: how many were taken, the updated (rank, accession, fragment), the failed (rank, accession, error), the outcome.

    attempt adds the columns fragment and error to ranked rows; a null error is a success.
    """
    tried = attempt(_best(ranked, k).filter(_filled("accession")))
    good, bad = F.col("error").isNull(), F.col("error").isNotNull()
    listed = lambda when, what: F.array_sort(F.collect_list(F.when(when, F.struct("rank", "accession", what))))  # noqa: E731  at most k
    out = tried.groupBy("session").agg(F.count("*").alias("n_taken"), listed(good, "fragment").alias("updated"), listed(bad, "error").alias("failed"))
    return out.withColumn("outcome", F.when(F.size("updated") == 0, "all failed").when(F.size("failed") > 0, "some failed").otherwise("applied"))


def placeholder_round(ranked: DataFrame, chosen: DataFrame) -> DataFrame:
    """chosen (session, accession, ...) with the sequence of its best ranked row that has one; null where there is none."""
    known = keep_first(ranked.filter(_filled("accession", "sequence")), ["session", "accession"], F.desc_nulls_last("score"), "place")
    return chosen.join(known.select("session", "accession", "sequence"), ["session", "accession"], "left")


def two_phase_ranks(scaffolds: DataFrame, generated: DataFrame, done: DataFrame, k: int, scorer: Callable[[Column, Column], Column]) -> DataFrame:
    """session, phase, rank, accession, sequence, score, summary of the k best of each session.

    Sessions in done have had their first phase: their generated rows are ranked, each with the last summary of its accession.
    The others' scaffolds are ranked, without summaries.
    """
    done = done.select("session").distinct()
    scored = lambda rows, phase: rows.filter(_filled("accession", "sequence")).select(*PAIR, "place", scorer(F.col("accession"), F.col("sequence")).alias("score"), F.lit(phase).alias("phase"))
    first, final = scored(scaffolds, 1).join(done, "session", "left_anti"), scored(generated, 2).join(done, "session", "left_semi")
    best = top_k(first.unionByName(final), SESSION, k, F.desc_nulls_last("score"), "place")
    last = generated.groupBy("session", "accession").agg(F.max_by("summary", "place").alias("summary"))
    out = best.join(last.withColumn("phase", F.lit(2)), ["session", "accession", "phase"], "left")
    return out.select("session", "phase", "rank", "accession", "sequence", "score", "summary")
