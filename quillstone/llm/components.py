"""Connected components: unions inside a task with NumPy, and over tables by alternating stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Tables of fewer rows are joined plainly: no key of theirs is too much for a task.
SMALL = 20_000


def merge_labels(labels: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """labels (each the smallest member of its component) after linking u[i] with v[i]."""
    while True:
        a, b = labels[u], labels[v]
        apart = a != b
        if not apart.any():
            return labels
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while (jumped := labels[labels]).tobytes() != labels.tobytes():
            labels = jumped


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in edges (u, v: longs); root is the smallest node of its component.

    Large stars and small stars in turn, each round written to the shared folder; the rounds grow
    with the logarithm of the largest component. All groupings are minima, combined before the shuffle.
    """
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    now = staged(now, "edges")
    before, digest = None, _digest(now)
    while digest != before and digest[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = join_hot(both.filter("v > u"), least, "u", 2 * digest[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = staged(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = staged(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        before, digest = digest, _digest(now)
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def join_hot(left: DataFrame, right: DataFrame, key: str, total: int, count: str = "n") -> DataFrame:
    """left outer join with right, whose keys are unique and whose count says how many rows of left have each.

    Keys with over a thousandth of left's `total` rows (so at most 1000 of them) are joined by broadcast,
    where they lie; the others, of which no group is large, by a shuffle.
    """
    if total < SMALL:
        return left.join(right, key, "left")
    most = max(1000, total // 1000)
    right = staged(right, "right")
    hot, rest = right.filter(F.col(count) > most), right.filter(F.col(count) <= most)
    there = left.join(F.broadcast(hot), key)
    return there.unionByName(left.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key, "left"))
