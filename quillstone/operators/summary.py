"""Column means of scored tables, with and without a penalty for missing rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def worst_fill_mean(df: DataFrame, metrics: dict[str, bool], valid: Column, include: Column) -> DataFrame:
    """One row of means. metrics: name to whether smaller is better.

    Over included rows, an invalid row or a missing value counts as the worst value of valid rows (of all rows
    if no valid row has one). Both passes are plain aggregates; the first sends one row.
    """
    rows = df.select(*metrics, valid.alias("__valid"), include.alias("__in"))
    for m in metrics:
        rows = rows.withColumn(m, F.when(~F.isnan(F.col(m).cast("double")), F.col(m).cast("double")))
    worst = rows.agg(*[F.coalesce(f(F.when(F.col("__valid"), F.col(m))), f(m)).alias(f"__worst_{m}") for m, smaller in metrics.items() for f in [F.max if smaller else F.min]])
    filled = rows.join(F.broadcast(worst))  # worst is one row
    means = [F.coalesce(F.avg(F.when(F.col("__in"), F.when(F.col("__valid") & F.col(m).isNotNull(), F.col(m)).otherwise(F.col(f"__worst_{m}")))), F.avg(m)).alias(m) for m in metrics]
    return filled.agg(*means)


def strict_means(df: DataFrame, metrics: list[str], *conditions: Column) -> DataFrame:
    """Means of the rows that meet all conditions, and their number."""
    for c in conditions:
        df = df.filter(c)
    return df.agg(*[F.avg(m).alias(m) for m in metrics], F.count("*").alias("n_rows"))


def append_row(board: DataFrame | None, row: DataFrame) -> DataFrame:
    """A leaderboard with one more row; columns may differ."""
    return row if board is None else board.unionByName(row, allowMissingColumns=True)


def histogram(df: DataFrame, value: str, lo: float, hi: float, bins: int) -> DataFrame:
    """bucket, n and density of each filled bin, with the mean and the population deviation of all values."""
    whole = df.agg(F.count(value).alias("total"), F.avg(value).alias("mu"), F.stddev_pop(value).alias("sigma"))
    width = (hi - lo) / bins
    bucket = F.least(F.greatest(F.floor((F.col(value) - lo) / width), F.lit(0)), F.lit(bins - 1))
    counted = df.filter(F.col(value).isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    return counted.join(F.broadcast(whole)).select("bucket", "n", (F.col("n") / (F.col("total") * width)).alias("density"), "mu", "sigma")
