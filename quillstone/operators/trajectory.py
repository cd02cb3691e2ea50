"""Tool events of dialogs, and rewards over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def tool_events(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row for each tool_response block: event, raw, tool_name, success, num_scored, best_round, global_best."""
    out = df.select(*keys, F.posexplode(T.blocks(F.col(text), "tool_response")).alias("event", "raw"))
    raw = F.col("raw")
    name = F.nullif(F.regexp_extract(raw, r"tool '([^']+)'", 1), F.lit(""))
    return out.withColumns(
        {
            "tool_name": name,
            "success": F.contains(raw, F.lit("ran successfully")),
            "num_scored": F.coalesce(T.labelled_number(raw, "num_sequences_scored").cast("long"), F.lit(0).cast("long")),
            "best_round": T.labelled_number(raw, "best_this_round"),
            "global_best": T.labelled_number(raw, "global_best"),
        }
    )


def clipped_share(best: Column, top: float, without: float) -> Column:
    """best / top within 0 and 1; `without` for no best at all."""
    return F.when(best.isNull(), F.lit(without)).otherwise(F.greatest(F.lit(0.0), F.least(best / top, F.lit(1.0))))


def turn_penalty(turns: Column, free: int, each: float, most: float) -> Column:
    """Nothing up to `free` turns, then `each` for every further one, `most` at worst (as a negative number)."""
    return -F.least(F.lit(most), F.greatest(turns - free, F.lit(0)) * each)


def overlong_penalty(length: Column, limit: int, buffer: int, factor: float) -> Column:
    """Falls from 0 over the last `buffer` tokens before the limit and beyond it."""
    return F.least(-(length - (limit - buffer)) / buffer * factor, F.lit(0.0))


def reward_mild(events: DataFrame, session: str) -> DataFrame:
    """Sum over all events: a success earns 0.3 and more for good scores, a failure costs 0.1; half of the clipped best on top."""
    good = F.col("success")
    step = F.when(good, 0.3).otherwise(-0.1) + F.when(good & (F.col("score") >= 15), 0.3).when(good & (F.col("score") >= 10), 0.15).otherwise(0.0)
    g = events.groupBy(session).agg(F.sum(step).alias("r_tools"), F.max(F.when(good, F.col("score"))).alias("best"), F.count("*").alias("n_events"))
    g = g.withColumn("r_score", clipped_share(F.col("best"), 20.0, -0.2)).withColumn("r_turns", turn_penalty(F.col("n_events"), 6, 0.05, 0.5))
    return g.withColumn("reward", F.col("r_tools") + 0.5 * F.col("r_score") + F.col("r_turns"))


def reward_capped(events: DataFrame, session: str, order: list, stage: Column, cap: int = 3) -> DataFrame:
    """Only the first `cap` successes of the stage earn, other successes earn 0.1, failures cost 0.1 with no cap."""
    earns = (F.col("success") & stage).cast("int")
    w = Window.partitionBy(session).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    counted = events.withColumn("__nth", F.sum(earns).over(w)).withColumn("__earns", earns)
    step = F.when((F.col("__earns") == 1) & (F.col("__nth") <= cap), 0.3).when(F.col("__earns") == 1, 0.0).when(F.col("success"), 0.1).otherwise(-0.1)
    g = counted.groupBy(session).agg(F.sum(step).alias("r_tools"), F.max(F.when(F.col("success"), F.col("score"))).alias("best"), F.sum("__earns").alias("n_stage"))
    return g.withColumn("reward", F.col("r_tools") + 1.5 * clipped_share(F.col("best"), 20.0, -0.2) - F.when(F.col("best").isNull(), 0.5).otherwise(0.0))


def repaired_roles(df: DataFrame, conversation: str, turn: str) -> DataFrame:
    """A turn after one that called a tool, of a role that cannot answer it and with the look of a result, becomes a tool turn."""
    w = Window.partitionBy(conversation).orderBy(turn)
    called = F.lag("calls_tool").over(w)
    fix = called & ~F.col("role").isin("assistant", "tool") & F.col("looks_like_result")
    return df.withColumn("fixed_role", F.when(F.coalesce(fix, F.lit(False)), "tool").otherwise(F.col("role")))


def last_turn(df: DataFrame, conversation: str, turn: str, condition: Column) -> DataFrame:
    """turn and text of the last row that meets the condition."""
    return df.filter(condition).groupBy(conversation).agg(F.max(turn).alias(turn), F.max_by("text", turn).alias("text"))


def session_key(*candidates: Column, text: Column) -> Column:
    """The first filled id, else one from the text's hash."""
    return F.coalesce(T.first_filled(*candidates), F.concat(F.lit("req-"), T.short_hash(text)))


def observation(tool: Column, n: Column, best: Column, whole: Column) -> Column:
    """The text that tool_events reads back."""
    return F.format_string("tool '%s' ran successfully\nnum_sequences_scored: %d\nbest_this_round: %.3f\nglobal_best: %.3f", tool, n, best, whole)
