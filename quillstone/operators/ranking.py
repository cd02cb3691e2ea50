"""Rank, deduplicate, cut and merge rows; every order is total, so results do not depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """One row for each key: the first in the order given."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).filter("__rank <= 1").drop("__rank")


def keep_last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key: the values of the last in the order, which must be total, and the place of the first (column first_place)."""
    others = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("__row"), F.min(order).alias("first_place"))
    return best.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in others], "first_place")


def top_k(df: DataFrame, groups: list[str], k: int, *order, rank: str = "rank") -> DataFrame:
    """At most k rows of each group; k = 0 keeps all. The limit is pushed below the shuffle."""
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))
    return ranked.filter(F.col(rank) <= k) if k else ranked


def quota(df: DataFrame, group: str, quotas: dict[str, int], *order) -> DataFrame:
    """At most quotas[value] rows of each value of group; the largest quota is pushed below the shuffle."""
    most = F.coalesce(*[F.when(F.col(group) == k, n) for k, n in quotas.items()], F.lit(0))
    return top_k(df.filter(most > 0), [group], max(quotas.values()), *order).filter(F.col("rank") <= most)


def fraction(df: DataFrame, groups: list[str], share: float, *order) -> DataFrame:
    """The first max(1, int(share * n)) rows of each group of n."""
    n = F.count("*").over(Window.partitionBy(*groups))
    w = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn("__n", n).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("__n") * share))).drop("__n")


def merge_top_k(old: DataFrame, new: DataFrame, keys: list[str], k: int, score: str) -> DataFrame:
    """The k best of both without repeats; of equal keys the old row stays."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    once = keep_first(both, keys, "__new", F.desc_nulls_last(score)).drop("__new")
    return once.orderBy(F.desc_nulls_last(score), *keys).limit(k)


def running_best(df: DataFrame, session: str, order: list, score: str) -> DataFrame:
    """best so far, the best before, and how much the row improved it (the best itself at the start)."""
    w = Window.partitionBy(session).orderBy(*order)
    out = df.withColumn("best", F.max(score).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("prev_best", F.max(score).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return out.withColumn("delta", F.when(F.col("prev_best").isNull(), F.col("best")).otherwise(F.col("best") - F.col("prev_best")))


def first_level(df: DataFrame, keys: list[str], level: str) -> DataFrame:
    """Rows of the lowest level that found any, for each key: a cascade of queries in one job."""
    return df.join(df.groupBy(*keys).agg(F.min(level).alias(level)), [*keys, level], "left_semi")


def shuffled_key(key: Column, seed: int) -> Column:
    """Sorts as a seeded shuffle does, and alike for any partitions."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")))


def with_ordinal(df: DataFrame, key: str, width: int = 10_000, name: str = "ordinal") -> DataFrame:
    """Places 0, 1, ... in the order of a unique integer key.

    Keys are dealt into ranges of `width`, and ranges by 10,000 again; only one count for each of the latter meets in one place.
    """
    bucketed = df.withColumn("__bucket", F.floor(F.col(key) / width))
    counts = bucketed.groupBy("__bucket").agg(F.count("*").alias("__n")).withColumn("__upper", F.floor(F.col("__bucket") / 10_000))
    upper = counts.groupBy("__upper").agg(F.sum("__n").alias("__m"))
    upper = upper.select("__upper", (F.sum("__m").over(Window.orderBy("__upper")) - F.col("__m")).alias("__base"))
    inside = F.sum("__n").over(Window.partitionBy("__upper").orderBy("__bucket")) - F.col("__n")
    before = counts.withColumn("__inside", inside).join(upper, "__upper").select("__bucket", (F.col("__base") + F.col("__inside")).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__bucket").orderBy(key)) - 1
    return bucketed.withColumn("__place", place).join(before, "__bucket").withColumn(name, F.col("__before") + F.col("__place")).drop("__bucket", "__place", "__before")


def equal_shards(df: DataFrame, key: str, k: int) -> DataFrame:
    """Contiguous shards of ceil(n / k) rows in the order of a unique integer key."""
    size = F.greatest(F.lit(1), F.ceil(F.lit(df.count()) / k))
    return with_ordinal(df, key).withColumn("shard", F.floor(F.col("ordinal") / size)).drop("ordinal")
