"""The seam for models: anything that scores batches of rows can be put in; nothing of a model is built here."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame


class Scorer(Protocol):
    #: DDL of the columns that score() adds.
    schema: str

    def score(self, rows: pd.DataFrame) -> pd.DataFrame: ...


class HashScorer:
    """A stand-in for tests: the same score for the same texts, from 0 to `top`."""

    schema = "score double"

    def __init__(self, *columns: str, top: float = 20.0):
        self.columns, self.top = columns, top

    def score(self, rows: pd.DataFrame) -> pd.DataFrame:
        joined = rows[list(self.columns)].fillna("").astype(str).agg("|".join, axis=1) if len(rows) else pd.Series(dtype=str)
        value = joined.map(lambda s: int(hashlib.sha256(s.encode()).hexdigest()[:8], 16) / 0xFFFFFFFF * self.top)
        return rows.assign(score=value.astype(float))


def scored(df: DataFrame, scorer: Scorer) -> DataFrame:
    """df with the scorer's columns; batches are scored where they lie."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield scorer.score(b)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{schema}, {scorer.schema}")


_REGISTRY: dict[str, Scorer] = {}


def register(name: str, scorer: Scorer) -> None:
    """A name that is taken gets a number behind it."""
    n, free = 2, name
    while free in _REGISTRY:
        free, n = f"{name}_{n}", n + 1
    _REGISTRY[free] = scorer


def named(name: str) -> Scorer:
    return _REGISTRY[name]
