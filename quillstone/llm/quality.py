"""Text quality by a generalised additive model with pairwise interactions.

Features of whole texts (shares of letters, marks and repeats; no label, language, source or id) are cut into
quantile bins. Boosting goes round the features in cycles, each time fitting a tree of at most three leaves to the gradient
of the log loss in that feature's bins and adding a small part of it to the feature's lookup table; then
the pairs that promise most get tables of their own from trees of two crossed cuts. A score is the sum of
one entry of each table, added for whole batches, through a logistic.

The model is fitted in one task on at most `sample` labelled rows (those of the smallest hashes of their id), which is
the only bounded step; every row is scored and, by the filter, judged by its own score, in one pass over the texts. Rows with
crc32(doc_id as text) mod 5 = 0 are held out.

Defined results: null and empty texts have all-zero features and a score like any text; a null doc_id counts as
held out and unlabelled; of several labels of one id the smallest counts; rows of one id are judged each for itself; without labels of both kinds all scores
are the labels' mean (0.5 without any); an empty table gives no rows; further columns are ignored by the report and
kept by the filter.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import staged, table

SAMPLE, BINS, PAIR_BINS, PAIRS, CYCLES, PAIR_CYCLES, RATE, THRESHOLD = 50_000, 64, 16, 8, 120, 60, 0.15, 0.3
FOLDS = 5
FEATURES = (
    "log_bytes log_words word_length upper_share digit_share symbol_share bang_share pipe_share stop_share comma_share wide_share vowel_share line_share "
    "distinct_share next_same_share top_word_share once_share marked_word_share upper_word_share short_word_share long_word_share words_per_stop same_line_share next_pair_share"
).split()
SYMBOLS = b"#$%&*+/<=>@\\^_`{|}~"
MARKS = frozenset(b"!#$%&*+/<=>@\\^_`{|}~")


def features_of(text: bytes | None) -> list[float]:
    """Of the whole text, in the order of FEATURES."""
    words = text.split() if text else []
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    size = len(text)
    c = np.bincount(np.frombuffer(text, np.uint8), minlength=256).tolist()
    upper, lower = sum(c[65:91]), sum(c[97:123])
    letters = max(1, upper + lower)
    seen = Counter(words)
    lens = np.fromiter(map(len, words), np.int64, n)
    symbols = sum(c[b] for b in SYMBOLS)
    marked = sum(k for w, k in seen.items() if w[-1] in MARKS) if symbols or c[33] else 0
    shouted = sum(k for w, k in seen.items() if w.isupper()) if upper else 0
    lines = [x for x in text.split(b"\n") if x]
    pairs = set(zip(words, words[1:], strict=False))
    return [
        float(np.log1p(size)),
        float(np.log1p(n)),
        float(lens.mean()),
        upper / letters,
        sum(c[48:58]) / size,
        symbols / size,
        c[33] / n,
        c[124] / n,
        c[46] / n,
        c[44] / n,
        sum(c[128:]) / size,
        sum(c[b] for b in b"aeiouAEIOU") / letters,
        c[10] / n,
        len(seen) / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        max(seen.values()) / n,
        sum(k == 1 for k in seen.values()) / n,
        marked / n,
        shouted / n,
        float((lens <= 3).mean()),
        float((lens > 15).mean()),
        n / (1 + c[46]),
        1 - len(set(lines)) / max(1, len(lines)),
        len(pairs) / max(1, n - 1),
    ]


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        values = [features_of(t) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array(values, pa.list_(pa.float64()))], names=["doc_id", "quality", "features"])


class Gam:
    """Lookup tables over binned features, and over pairs of them."""

    def __init__(self, x: np.ndarray, y: np.ndarray, cycles: int = CYCLES, pair_cycles: int = PAIR_CYCLES, pairs: int = PAIRS, rate: float = RATE):
        mean = float(y.mean()) if len(y) else 0.5
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
        self.coarse = [np.unique(np.quantile(c, np.linspace(0, 1, PAIR_BINS + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        self.constant = mean
        self.base = 0.0
        if not 0 < mean < 1:
            return
        self.base, self.constant = float(np.log(mean / (1 - mean))), None
        bins, coarse = self._bins(x, self.cuts), self._bins(x, self.coarse)
        f = np.full(len(y), self.base)
        for _ in range(cycles):
            for j, t in enumerate(self.tables):
                p = 1 / (1 + np.exp(-f))
                step = rate * self._leaves(np.bincount(bins[j], y - p, len(t)), np.bincount(bins[j], p * (1 - p), len(t)))
                t += step
                f += step[bins[j]]
        p = 1 / (1 + np.exp(-f))
        gains = []
        for a in range(x.shape[1]):
            for b in range(a):
                g, h = self._grids(coarse, a, b, y - p, p * (1 - p))
                gains.append((self._crossed(g, h)[0], a, b))
        for _, a, b in sorted(gains, reverse=True)[:pairs]:
            self.pairs.append((a, b, np.zeros((len(self.coarse[a]) + 1, len(self.coarse[b]) + 1))))
        for _ in range(pair_cycles):
            for a, b, t in self.pairs:
                p = 1 / (1 + np.exp(-f))
                g, h = self._grids(coarse, a, b, y - p, p * (1 - p))
                step = rate * self._crossed(g, h)[1]
                t += step
                f += step[coarse[a], coarse[b]]

    @staticmethod
    def _bins(x: np.ndarray, cuts: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(c, v, "right") for c, v in zip(cuts, x.T, strict=True)]

    def _grids(self, coarse, a: int, b: int, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shape = (len(self.coarse[a]) + 1, len(self.coarse[b]) + 1)
        at = coarse[a] * shape[1] + coarse[b]
        return np.bincount(at, g, shape[0] * shape[1]).reshape(shape), np.bincount(at, h, shape[0] * shape[1]).reshape(shape)

    @staticmethod
    def _leaves(g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """A tree of at most two cuts: the best first, then the best of either side."""
        edges = [0, len(g)]
        G, H = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
        for _ in range(2):
            best = (1e-9, None)
            for lo, hi in zip(edges, edges[1:]):
                m = np.arange(lo + 1, hi)
                if len(m):
                    left, right, whole = ((G[m] - G[lo]) ** 2 / (H[m] - H[lo] + 1), (G[hi] - G[m]) ** 2 / (H[hi] - H[m] + 1), (G[hi] - G[lo]) ** 2 / (H[hi] - H[lo] + 1))
                    gain = left + right - whole
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], int(m[k]))
            if best[1] is None:
                break
            edges = sorted([*edges, best[1]])
        out = np.zeros(len(g))
        for lo, hi in zip(edges, edges[1:]):
            out[lo:hi] = (G[hi] - G[lo]) / (H[hi] - H[lo] + 1)
        return out

    @staticmethod
    def _crossed(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
        """The best pair of cuts, one on each feature; its gain and the four leaves over the grid."""
        G, H = (np.pad(np.cumsum(np.cumsum(v, 0), 1), ((1, 0), (1, 0))) for v in (g, h))
        if min(g.shape) < 2:
            return 0.0, np.zeros(g.shape)
        quarters = []
        for V in (G, H):
            a = V[1:-1, 1:-1]
            quarters.append((a, V[1:-1, -1:] - a, V[-1:, 1:-1] - a, V[-1, -1] - V[1:-1, -1:] - V[-1:, 1:-1] + a))
        gain = sum(q**2 / (k + 1) for q, k in zip(*quarters, strict=True)) - G[-1, -1] ** 2 / (H[-1, -1] + 1)
        i, j = np.unravel_index(int(gain.argmax()), gain.shape)
        out = np.empty(g.shape)
        for (rows, cols), q, k in zip(((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None))), *quarters, strict=True):
            out[rows, cols] = q[i, j] / (k[i, j] + 1)
        return float(gain[i, j]), out

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None or not len(x):
            return np.full(len(x), self.constant if self.constant is not None else 0.5)
        bins, coarse = self._bins(x, self.cuts), self._bins(x, self.coarse)
        f = self.base + sum(t[b] for t, b in zip(self.tables, bins, strict=True))
        return 1 / (1 + np.exp(-(f + sum(t[coarse[a], coarse[b]] for a, b, t in self.pairs))))


def _fit(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["doc_id"], kind="stable")
    model = Gam(np.array(rows["features"].tolist()).reshape(len(rows), len(FEATURES)), rows["quality"].to_numpy(np.float64))
    return pd.DataFrame({"model": [pickle.dumps(model.__dict__)]})


def _scorer(sent, threshold: float | None) -> Callable:
    """Batches whose last column is the text get their scores in its place; with a threshold, only rows that reach it stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Gam.__new__(Gam)
        model.__dict__.update(pickle.loads(sent.value))
        for b in batches:
            x = np.array([features_of(t) for t in b.column(b.num_columns - 1).to_pylist()]).reshape(b.num_rows, len(FEATURES))
            score = pa.array(model.score(x))
            b = pa.RecordBatch.from_arrays([*b.columns[:-1], score], names=[*b.schema.names[:-1], "score"])
            yield b if threshold is None else b.filter(pc.greater_equal(score, threshold))

    return run


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def _utf8():
    return F.encode(F.col("text").cast("string"), "UTF-8")


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> bytes:
    """The model, from the features of at most `sample` labelled rows; only ids and labels are shuffled to choose them."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter(~held_out()).distinct()
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = staged(known.join(ids, "doc_id", "left_semi").orderBy(*order).limit(sample), "chosen")  # at most `sample` rows of two numbers
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _utf8().alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")
    rows = texts.mapInArrow(_featured, "doc_id long, quality int, features array<double>").orderBy(*order, "features").limit(sample)
    row = rows.groupBy(F.lit(0).alias("all")).applyInPandas(_fit, "model binary").first()
    return bytes(row["model"]) if row else _fit(pd.DataFrame({"doc_id": [], "features": [], "quality": []}))["model"][0]


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, sample))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _utf8().alias("text"))
    scored = rows.mapInArrow(_scorer(sent, None), "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """docs, in its own columns, without the rows that the classifier rejects; each row is judged by its own text."""
    sent = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, sample))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _utf8().alias("text"))
    return packed.mapInArrow(_scorer(sent, threshold), T.StructType([T.StructField("row", docs.schema), T.StructField("score", T.DoubleType())])).select("row.*")


def op6_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op6_quality_gam": op6_quality_gam}
ORACLES: dict[str, str] = {}
