"""From descriptions to motifs: classes by a composite score, an instance's letters or a made-up match, no forbidden pattern."""

from __future__ import annotations

import difflib
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import design as D
from ..functions import seq as S
from .ranking import top_k
from .sequences import shortest_matches

#: Classes that are broadcast at a time.
BLOCK = 10_000
# The weights of a class's two texts, of words and letters in each, and what its instances may add.
FIELDS, WORDS, LETTERS, MOST_INSTANCES = (("name", 0.45), ("about", 0.35)), 0.6, 0.4, 100
_WORD = re.compile(r"[a-zA-Z0-9\-_]+")


def class_score(query: str | None, name: str | None, about: str | None, instances: int | None) -> float:
    """Cosine of word counts and ratio of matching letters of the query with both texts, plus a thousandth for each instance, 0.1 at most."""
    said = _WORD.findall((query or "").lower())
    words, total = Counter(said), 0.0
    for text, (_, weight) in zip((name, about), FIELDS, strict=True):
        other = _WORD.findall((text or "").lower())
        counts = Counter(other)
        norm = sum(v * v for v in words.values()) ** 0.5 * sum(v * v for v in counts.values()) ** 0.5
        cosine = sum(v * counts[w] for w, v in words.items()) / norm if norm else 0.0
        total += weight * (WORDS * cosine + LETTERS * difflib.SequenceMatcher(None, " ".join(said), " ".join(other)).ratio())
    return total + min(instances or 0, MOST_INSTANCES) / 1000


@F.pandas_udf(DoubleType())
def class_scores(query: pd.Series, name: pd.Series, about: pd.Series, instances: pd.Series) -> pd.Series:
    rows = zip(query, name, about, instances, strict=True)
    return pd.Series([class_score(q, n, a, None if pd.isna(i) else int(i)) for q, n, a, i in rows], dtype="float64")


def best_classes(queries: DataFrame, text: str, classes: DataFrame, k: int = 8, least: float = 0.2, digits: int = 6) -> DataFrame:
    """text, class, score, rank: of each distinct text the k best classes (class, name, about, n) with a score of `least` or more.

    Equal texts are scored once. Classes are broadcast in blocks of at most BLOCK by a hash of their name, and a text's best of every block
    meet in one ranking; of equal scores the smaller class comes first. Null texts are left out.
    """
    asked = queries.select(F.col(text).alias("text")).filter("text is not null").distinct()
    n, best = classes.count(), None
    blocks = 1 if n <= BLOCK else -(-2 * n // BLOCK)  # half full, so that uneven hashes fit
    for b in range(blocks):
        part = F.broadcast(classes.filter(F.pmod(F.xxhash64("class"), F.lit(blocks)) == b).select("class", "name", "about", "n"))
        scored = asked.join(part, F.lit(True)).withColumn("score", F.round(class_scores("text", "name", "about", "n"), digits)).filter(F.col("score") >= least)
        mine = top_k(scored.select("text", "class", "score"), ["text"], k, F.desc("score"), "class").drop("rank")
        best = mine if best is None else best.unionByName(mine)
    return top_k(best, ["text"], k, F.desc("score"), "class")


def resolved(queries: DataFrame, text: str, classes: DataFrame, instances: DataFrame, forbid: list[str], k: int = 8, least: float = 0.2) -> DataFrame:
    """text, class, score, motif, source: a motif for each distinct text.

    Its classes are tried from the best; the first whose instance (class, letters) is of the twenty letters alone gives the motif.
    If none does, a short match of the last class's pattern (class, name, about, n, pattern) is made up. A forbidden pattern in the motif is
    repaired if one letter in place of an A can. A text without a class has no row.
    """
    known = classes.select("class", "pattern").join(instances.select("class", "letters"), "class", "left").withColumn("made", shortest_matches("pattern"))
    tried = best_classes(queries, text, classes, k, least).join(known, "class")
    real = S.is_valid(F.upper("letters"))
    one = F.struct("class", "score", F.upper("letters").alias("letters"))
    made = F.max_by(F.struct(F.lit(None).cast("string").alias("class"), F.lit(None).cast("double").alias("score"), F.col("made").alias("letters")), F.when(F.coalesce("pattern", F.lit("")) != "", F.col("rank")))
    picked = tried.groupBy("text").agg(F.min_by(one, F.when(real, F.col("rank"))).alias("real"), made.alias("made"))
    x = F.coalesce("real", "made")
    source = F.when(F.col("real").isNotNull(), "instance").otherwise("pattern")
    return picked.select("text", x["class"].alias("class"), x["score"].alias("score"), S.restricted(D.last_repair(x["letters"], forbid)).alias("motif"), source.alias("source"))
