"""Token counts by a two-tier lookup of pre-token lengths, without shuffling any pre-token.

The model never joins a piece across the start of a run of spaces or across a line feed, so a text's
count is the sum over its pre-tokens. Tier one is a broadcast table of the corpus's frequent pre-tokens
with their lengths. Every task counts all pre-tokens of its rows and sends one summary of at most
`frequent` entries; summaries are merged in a tree whose nodes take 16 each, so the broadcast holds at most
`frequent` entries at any input size. Tier two is a cache in each worker, cleared when it reaches a fixed number of entries.
Pre-tokens of over `LONGEST` characters stay out of both tiers and are encoded each time, so 20,000 entries are
under 6 MB and a cache under 300 MB. Neither tier alters a count.

Defined results: a null or empty text has 0 bytes and 0 tokens; null and repeated ids are kept; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table, worker_cache

SPACE = "▁"  # stands for the space in this model's pieces
FREQUENT, TRACKED, CACHED, DOCS = 20_000, 250_000, 800_000, 100
FANOUT, LONGEST = 16, 64
PRE_TOKENS = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")


def pre_tokens(text: str) -> list[str]:
    """A leading space is put before a text by the model itself."""
    return PRE_TOKENS.findall(SPACE + text.replace(" ", SPACE)) if text else []


def model(path: str | None):
    """The sentencepiece model, once per worker."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    kept = worker_cache("sentencepiece")
    if path not in kept:
        kept[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return kept[path]


def lengths(sp, tokens: list[str]) -> list[int]:
    """Many tokens are encoded as one text of lines: the id of a line feed stands between theirs."""
    feed = sp.piece_to_id("<0x0A>")
    whole = [t for t in tokens if t != "\n"]
    n: list[int] = []
    for k in range(0, len(whole), 1000):
        ids = np.asarray(sp.encode("\n" + "\n".join(whole[k : k + 1000]) + "\n"))
        n += (np.diff(np.flatnonzero(ids == feed)) - 1).tolist()
    each = iter(n)
    return [1 if t == "\n" else next(each) for t in tokens]


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()
    for b in batches:
        for text in b.column("text").to_pylist():
            if text:
                seen.update(t for t in pre_tokens(text) if len(t) <= LONGEST)
                if len(seen) > TRACKED:
                    seen = Counter(dict(seen.most_common(TRACKED // 4)))
    yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([pickle.dumps(dict(seen.most_common(FREQUENT)))], pa.binary())], names=["task", "summary"])


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    seen: Counter = Counter()
    for blob in rows["summary"]:
        seen.update(pickle.loads(blob))
        if len(seen) > TRACKED:
            seen = Counter(dict(seen.most_common(TRACKED // 4)))
    return pd.DataFrame({"task": [int(rows["task"].min())], "summary": [pickle.dumps(dict(seen.most_common(FREQUENT)))]})


def frequent_pre_tokens(docs: DataFrame, n: int = FREQUENT) -> dict[str, int]:
    """Frequent pre-tokens with counts, from all rows, through a tree whose nodes take FANOUT summaries each, however many tasks there are."""
    rows = staged(docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_summaries, "task int, summary binary"), "summaries")
    last = rows.agg(F.max("task")).first()[0] or 0
    while last >= FANOUT:
        rows, last = rows.withColumn("task", F.floor(F.col("task") / FANOUT).cast("int")).groupBy("task").applyInPandas(_merge, "task int, summary binary"), last // FANOUT
    total: Counter = Counter()
    for row in rows.toLocalIterator():  # at most FANOUT summaries of FREQUENT entries
        total.update(pickle.loads(row["summary"]))
    return dict(total.most_common(n))


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 4096, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of docs."""
    sp = model(path)
    common = list(frequent_pre_tokens(docs, frequent))
    sent = docs.sparkSession.sparkContext.broadcast(dict(zip(common, lengths(sp, common), strict=True)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, first, second = model(path), sent.value, worker_cache(f"token lengths:{path}")
        second.update(first)
        get = second.__getitem__
        for b in batches:
            texts, n = b.column("text").to_pylist(), []
            for k in range(0, len(texts), DOCS):
                docs_tokens = [pre_tokens(t) if t else [] for t in texts[k : k + DOCS]]
                # Long ones are counted apart: nothing of them is kept.
                long = [[t for t in tokens if len(t) > LONGEST] for tokens in docs_tokens]
                extra = [sum(lengths(sp, x)) if x else 0 for x in long]
                docs_tokens = [[t for t in tokens if len(t) <= LONGEST] if x else tokens for tokens, x in zip(docs_tokens, long, strict=True)]
                misses = list({t for tokens in docs_tokens for t in tokens if t not in second})
                if len(second) + len(misses) > CACHED:
                    second.clear()
                    second.update(first)
                    misses = list({t for tokens in docs_tokens for t in tokens if t not in second})
                second.update(zip(misses, lengths(sp, misses), strict=True))
                n += [sum(map(get, tokens)) + more for tokens, more in zip(docs_tokens, extra, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op4_token_counts_two_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


QUERIES = {"op4_token_counts_two_tier": op4_token_counts_two_tier}
ORACLES: dict[str, str] = {}
