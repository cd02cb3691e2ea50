"""Lookups between tables: first or last match, new rows, fallbacks over levels, negatives."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import keep_first, shuffled_key, top_k, with_ordinal


def lookup_first(left: DataFrame, right: DataFrame, key: str, *order) -> DataFrame:
    """Inner join with the first row of right for each key."""
    return left.join(keep_first(right, [key], *order), key)


def missing_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).distinct().join(right, key, "left_anti")


def enrich_last(left: DataFrame, right: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Left join with the last value of each key; the order must be total but for equal values."""
    return left.join(right.groupBy(key).agg(F.max_by(value, order).alias(value)), key, "left")


def new_rows(now: DataFrame, before: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of now whose keys are not in before; nulls are equal."""
    same = None
    for k in keys:
        one = now[k].eqNullSafe(before[k])
        same = one if same is None else same & one
    return now.join(before, same, "left_anti")


def zip_rows(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    """The i-th row of left with the i-th of right, by the order of unique integer keys; the longer one is cut."""
    return with_ordinal(left, left_key).join(with_ordinal(right, right_key), "ordinal")


def fallback_levels(candidates: DataFrame, key: str, level: str, *order) -> DataFrame:
    """The first candidate of the lowest level that has one."""
    return keep_first(candidates, [key], level, *order)


def negatives(queries: DataFrame, pool: DataFrame, query: str, item: str, n: int, seed: int, reach: int = 4) -> DataFrame:
    """n items for each query, other than its own, alike for any partitions.

    Items lie in a seeded order (cut into ranges, so no task sorts all); a query takes those after a place that its own
    hash picks, around the end of the pool. The pool must hold over n items.
    """
    total = pool.count()
    hashed = F.conv(F.substring(shuffled_key(F.col(item), seed), 1, 15), 16, 10).cast("long")
    placed = with_ordinal(pool.select(item).distinct().withColumn("__h", hashed), "__h", width=1 << 50, name="place").drop("__h")
    start = F.pmod(F.conv(F.substring(shuffled_key(F.col(query), seed + 1), 1, 15), 16, 10).cast("long"), F.lit(max(total, 1)))
    wanted = queries.withColumn("try", F.explode(F.sequence(F.lit(0), F.lit(n + reach)))).withColumn("place", F.pmod(start + F.col("try"), F.lit(max(total, 1))))
    found = wanted.join(placed.withColumnRenamed(item, "negative"), "place").filter(F.col("negative") != F.col(item)).drop("place")
    return top_k(found, [query], n, "try").drop("try")


def inverted(edges: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Sorted distinct values of each key."""
    return edges.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias(out))


def previous_rows(df: DataFrame, keys: list[str], order: str, **columns) -> DataFrame:
    """Further columns with another column's value in the row before."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumns({name: F.lag(c).over(w) for name, c in columns.items()})
