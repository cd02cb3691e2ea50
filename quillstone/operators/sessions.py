"""Rounds of scored candidates in a session: what is new, how good it is, what it improves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import running_best, top_k


def rounds(scored: DataFrame) -> DataFrame:
    """session, round, n_new, best_round, best, prev_best, delta from (session, round, candidate, score).

    A candidate is new in the first round it stands in; a round without new ones improves nothing.
    """
    once = scored.groupBy("session", "round", "candidate").agg(F.max("score").alias("score"))
    first = scored.groupBy("session", "candidate").agg(F.min("round").alias("first"))
    new = once.join(first, ["session", "candidate"]).withColumn("new", F.col("round") == F.col("first"))
    by_round = new.groupBy("session", "round").agg(F.count_if("new").alias("n_new"), F.max(F.when(F.col("new"), F.col("score"))).alias("best_round"))
    return running_best(by_round, "session", ["round"], "best_round")


def pool(scored: DataFrame, k: int) -> DataFrame:
    """The k best candidates of each session over all rounds; a candidate keeps the score of its first round."""
    kept = scored.groupBy("session", "candidate").agg(F.min_by("score", "round").alias("score"))
    return top_k(kept, ["session"], k, F.desc_nulls_last("score"), "candidate")
