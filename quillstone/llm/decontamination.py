"""Benchmark decontamination by a broadcast hash set of normalised word n-grams.

Words of benchmark items get numbers; an item's windows of n consecutive words (one shorter window for
an item of fewer words) become 64-bit polynomial hashes over those numbers. Documents are scanned with
vectorised window hashes, in which a word that no item has breaks every window; each hit is verified
word by word. Tasks cut items into parts and build tables of `block_windows` windows at most (some 200 bytes a window).
One table is broadcast, scanned for, and destroyed before the next, so neither driver nor executors hold more than
one; hits of several tables are united by row.

Defined results: null and empty texts have no words; an item without words or id names nothing (a
null-id item's windows still hit); repeated item ids count once; an empty benchmark hits nothing;
further columns, whatever their names, are ignored by the report and kept by the cleaning form.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import uuid
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import staged, table, worker_cache

N, BLOCK_WINDOWS = 10, 500_000
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Windows of one part of an item.
PART = 10_000
ROW, TEXT, WORDS, SPANS, ITEMS = (f"__quillstone_{x}" for x in ("row", "text", "words", "spans", "items"))
HITS = f"{WORDS} long, {SPANS} array<struct<first:long,last:long>>, {ITEMS} array<long>"


def words_of(text: bytes | None) -> list[bytes]:
    """bytes.lower() changes A-Z alone; bytes of 0x80 and above are word characters."""
    return WORD.findall(text.lower()) if text else []


class Windows:
    """Windows of some items, for scanning."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]], n: int = N):
        self.n, self.number, by_size = n, {}, {}
        for item, words in items:
            size = min(n, len(words))
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words]
            for i in range(len(words) - size + 1 if words else 0):
                by_size.setdefault(size, {}).setdefault(tuple(ids[i : i + size]), set()).add(item)
        self.sizes = {}
        for size, found in by_size.items():
            rows = np.array(list(found), np.int64).reshape(len(found), size)
            hashes = self._hash(rows.astype(np.uint64))
            order = np.argsort(hashes, kind="stable")
            owners = list(found.values())
            self.sizes[size] = (hashes[order], rows[order], [sorted((x for x in owners[k]), key=str) for k in order])

    @staticmethod
    def _hash(rows: np.ndarray) -> np.ndarray:
        h = np.zeros(len(rows), np.uint64)
        for k in range(rows.shape[1]):
            h = (h ^ rows[:, k]) * BASE
            h ^= h >> np.uint64(29)
        return h

    def scan(self, docs: list[list[bytes]]) -> list[tuple[np.ndarray, set] | None]:
        """For each document the hit flags of its words and the items found, or None."""
        starts = np.cumsum([0] + [len(d) + 1 for d in docs])
        ids = np.zeros(starts[-1] + 1, np.int64)
        get = self.number.get
        for d, s in zip(docs, starts, strict=False):
            if d:
                ids[s : s + len(d)] = np.fromiter(map(get, d, repeat(0)), np.int64, len(d))
        out: list = [None] * len(docs)
        gaps = np.concatenate([[0], np.cumsum(ids == 0)])
        for size, (hashes, rows, owners) in self.sizes.items():
            if len(ids) < size:
                continue
            at = np.flatnonzero(gaps[size:] == gaps[:-size])
            for k in range(0, len(at), 1 << 20):
                part = at[k : k + (1 << 20)]
                h = self._hash(np.stack([ids[part + i] for i in range(size)], 1).astype(np.uint64))
                lo = np.searchsorted(hashes, h)
                near = (lo < len(hashes)) & (hashes[np.minimum(lo, len(hashes) - 1)] == h)
                for p, j, key in zip(part[near], lo[near], h[near], strict=True):
                    window = ids[p : p + size]
                    while j < len(hashes) and hashes[j] == key and (rows[j] != window).any():
                        j += 1
                    if j == len(hashes) or hashes[j] != key:
                        continue
                    d = int(np.searchsorted(starts, p, "right") - 1)
                    if out[d] is None:
                        out[d] = (np.zeros(len(docs[d]), bool), set())
                    out[d][0][p - starts[d] : p - starts[d] + size] = True
                    out[d][1].update(owners[j])
        return out


def _spans(flags: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [{"first": int(a), "last": int(b) - 1} for a, b in zip(edges[::2], edges[1::2], strict=True)]


def _parts(n: int, block_windows: int) -> Callable:
    most = max(1, min(PART, block_windows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Stretches of an item's words of at most `most` windows; neighbours share n - 1 words."""
        for b in batches:
            out = []
            for item, text in zip(b.column("item_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                words = words_of(text)
                windows = max(1, len(words) - n + 1) if words else 0
                out += [(item, b" ".join(words[k : k + most + n - 1]), min(most, windows - k)) for k in range(0, windows, most)]
            columns = zip(*out, strict=True) if out else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.int64()), strict=True)], names=["item_id", "words", "windows"])

    return run


def _build(n: int, block_windows: int) -> Callable:
    def build(rows: pd.DataFrame) -> pd.DataFrame:
        """Tables of at most block_windows windows, filled one after another."""
        out, block, size = [], [], 0
        for item, words, windows in zip(rows["item_id"].astype("Int64"), rows["words"], rows["windows"], strict=True):
            if block and size + windows > block_windows:
                out.append(pickle.dumps(Windows(block, n).__dict__))
                block, size = [], 0
            block.append((None if item is pd.NA else int(item), words.split(b" ")))
            size += windows
        return pd.DataFrame({"table": [*out, pickle.dumps(Windows(block, n).__dict__)]})

    return build


def window_tables(benchmark: DataFrame, n: int = N, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """(id, table): the benchmark's windows in tables of at most block_windows, built by tasks."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.encode(F.col("text").cast("string"), "UTF-8").alias("text")).filter("text is not null").distinct()
    parts = staged(items.mapInArrow(_parts(n, block_windows), "item_id long, words binary, windows long"), "parts")
    total = parts.agg(F.coalesce(F.sum("windows"), F.lit(0))).first()[0]
    group = F.pmod(F.xxhash64("item_id", "words"), F.lit(max(1, -(-total // block_windows))))
    tables = parts.groupBy(group.alias("group")).applyInPandas(_build(n, block_windows), "table binary")
    return staged(tables.withColumn("id", F.monotonically_increasing_id()), "tables")


def _scanner(sent, columns: int, hits_only: bool) -> Callable:
    name = uuid.uuid4().hex

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache("windows")
        if name not in cache:  # a worker keeps one table
            cache.clear()
            cache[name] = Windows.__new__(Windows)
            cache[name].__dict__.update(pickle.loads(sent.value))
        windows = cache[name]
        kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
        for b in batches:
            texts = b.column(TEXT).to_pylist()
            counts, spans, items = [], [], []
            for k in range(0, len(texts), 500):
                docs = [words_of(t) for t in texts[k : k + 500]]
                for d, hit in zip(docs, windows.scan(docs), strict=True):
                    counts.append(len(d))
                    spans.append(_spans(hit[0]) if hit else [])
                    items.append(sorted(x for x in hit[1] if x is not None) if hit else [])
            kept = [b.column(i) for i in range(columns)]
            out = pa.RecordBatch.from_arrays([*kept, pa.array(counts, pa.int64()), pa.array(spans, kind), pa.array(items, pa.list_(pa.int64()))], names=[*b.schema.names[:columns], WORDS, SPANS, ITEMS])
            yield out.filter(pa.array([bool(s) for s in spans], pa.bool_())) if hits_only else out

    return scan


def find_windows(docs: DataFrame, benchmark: DataFrame, keep: list[str], n: int = N, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The columns `keep` of docs with the number of words, spans (first and last word of each hit run) and items of every row."""
    spark = docs.sparkSession
    tables = window_tables(benchmark, n, block_windows)
    ids = [r["id"] for r in tables.select("id").collect()]  # one number for each table
    send = lambda i: spark.sparkContext.broadcast(bytes(tables.filter(F.col("id") == i).first()["table"]) if i is not None else pickle.dumps(Windows([], n).__dict__))
    row = docs.select(*[F.col(f"`{c}`") for c in keep], F.encode(F.col("text").cast("string"), "UTF-8").alias(TEXT))
    kept = T.StructType(row.schema.fields[:-1])
    hits = T.StructType.fromDDL(HITS)
    if len(ids) < 2:
        return row.mapInArrow(_scanner(send(ids[0] if ids else None), len(keep), False), T.StructType([*kept, *hits]))
    # Rows get a number once, so that what each table finds can be united; only hits are kept of all tables but the first.
    numbered = staged(row.withColumn(ROW, F.monotonically_increasing_id()), "numbered")
    numbered = numbered.select(ROW, *[F.col(f"`{c}`") for c in keep], TEXT)
    narrow, found = numbered.select(ROW, TEXT), None
    for i in ids:
        sent = send(i)
        part = staged(narrow.mapInArrow(_scanner(sent, 1, True), f"{ROW} long, {HITS}"), "hits").drop(WORDS)
        found = part if found is None else found.unionByName(part)
        sent.destroy()
    both = [F.flatten(F.collect_list(SPANS)).alias(SPANS), F.array_sort(F.array_distinct(F.flatten(F.collect_list(ITEMS)))).alias(ITEMS)]
    counted = numbered.mapInArrow(_scanner(send(None), len(keep) + 1, False), T.StructType([T.StructField(ROW, T.LongType()), *kept, *hits])).drop(SPANS, ITEMS)
    out = counted.join(found.groupBy(ROW).agg(*both), ROW, "left").drop(ROW)
    return out.withColumns({SPANS: F.coalesce(SPANS, F.array().cast(hits[1].dataType)), ITEMS: F.coalesce(ITEMS, F.array().cast("array<bigint>"))})


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hit, count, sha = [], [], []
        for spans, items in zip(b.column(SPANS).to_pylist(), b.column(ITEMS).to_pylist(), strict=True):
            words: set[int] = set()
            for s in spans:
                words.update(range(s["first"], s["last"] + 1))
            hit.append(len(words))
            count.append(len(items))
            sha.append(hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column(WORDS), pa.array(hit, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string()), pa.array([h > 0 for h in hit], pa.bool_())], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def report(docs: DataFrame, benchmark: DataFrame, n: int = N, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """What of each row of docs occurs in the benchmark."""
    found = find_windows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, ["doc_id"], n, block_windows)
    return found.mapInArrow(_report, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def _remover(columns: list[str]) -> Callable:
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for text, spans in zip(b.column("text").to_pylist(), b.column(SPANS).to_pylist(), strict=True):
                if spans:
                    data = text.encode()
                    words = [m.span() for m in WORD.finditer(data.lower())]
                    gone = [(words[s["first"]][0], words[s["last"]][1]) for s in sorted(spans, key=lambda s: s["first"])]
                    keep, at = [], 0
                    for x, y in gone:
                        keep.append(data[at : max(at, x)])
                        at = max(at, y)
                    text = b"".join([*keep, data[at:]]).decode()
                texts.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else b.column(c) for c in columns], names=columns)

    return remove


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", n: int = N, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """docs, in its own columns, without the documents that hold a window or without the hit spans."""
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove must be documents or spans, not {remove}")
    found = find_windows(docs, benchmark, docs.columns, n, block_windows)
    if remove == "documents":
        return found.filter(F.size(SPANS) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
    return found.drop(WORDS, ITEMS).mapInArrow(_remover(docs.columns), docs.schema)


def op5_decontaminate_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op5_decontaminate_ngrams": op5_decontaminate_ngrams}
ORACLES: dict[str, str] = {
    "op5_decontaminate_ngrams": """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS x FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
p AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS x FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM g) WHERE len(w) >= k)),
h AS (SELECT p.doc_id, p.i, p.k, g.item_id FROM p JOIN g USING (k, x)),
n AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)"""
}
