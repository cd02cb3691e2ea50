"""Runs, islands, merges and overlaps of intervals over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Runs of consecutive integers: keys, first, last, n."""
    once = df.select(*keys, position).distinct()
    run = F.col(position) - F.row_number().over(Window.partitionBy(*keys).orderBy(position))
    return once.withColumn("__run", run).groupBy(*keys, "__run").agg(F.min(position).alias("first"), F.max(position).alias("last"), F.count("*").alias("n")).drop("__run")


def merge(df: DataFrame, keys: list[str], start: str, end: str, gap: int = 0) -> DataFrame:
    """Disjoint intervals of each key; those at most `gap` apart are joined."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col(start) > before + gap), 1).otherwise(0)
    island = F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("__new", new).withColumn("__island", island).groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_merged")).drop("__island")


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Pairs of half-open intervals (ls, le) and (rs, re) of equal keys that overlap.

    Each interval goes to the bins it touches, and a pair is taken in the bin where the later of both starts,
    so pairs come once and the join is an equi-join.
    """
    bins = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.col(e) - 1) / width)))
    a = left.filter("ls < le").withColumn("__bin", bins("ls", "le"))
    b = right.filter("rs < re").withColumn("__bin", bins("rs", "re"))
    own = F.floor(F.greatest("ls", "rs") / width) == F.col("__bin")
    return a.join(b, [*keys, "__bin"]).filter((F.col("ls") < F.col("re")) & (F.col("rs") < F.col("le")) & own).drop("__bin")


def consecutive_blocks(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Runs of rows with equal values: keys, value, first, last, n."""
    w = Window.partitionBy(*keys).orderBy(order)
    new = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & F.lag(F.lit(1)).over(w).isNotNull(), 0).otherwise(1)
    block = F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("__new", new).withColumn("__block", block).groupBy(*keys, "__block", value).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("__block")
