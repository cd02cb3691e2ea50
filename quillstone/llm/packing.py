"""Harmonic packing of tokenized documents into fixed-length sequences.

A piece of length r belongs to class j = capacity // r (at most `classes`), and a bin of class j takes
exactly j pieces, whatever they are: each task fills its bins alone. Documents are first cut at the
capacity; a tail that would leave more than capacity / 64 of a bin empty in its class first gives up
a piece of exactly capacity // (j + 1), which fills class j + 1 to the brim, so tails end after a few
cuts. What tasks could not fill (under `classes` pieces of each class, at most 2016 rows of a task) goes up a tree: a node
fills bins from the rests of `FANOUT` tasks or nodes and leaves as little again; the last one packs its rest first-fit.

Defined results: a null text is empty and gives the end token alone; null and repeated ids are kept,
each row packed for itself; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table, worker_cache

CAPACITY, CLASSES, END_ID = 2048, 64, 1
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class int, sequence_id long, offset long, task long"
#: A worker keeps at most so many words with their ids.
CACHED_WORDS = 800_000
#: Tasks whose unfilled bins meet in one task: at most some 500,000 rows.
FANOUT = 256


def cut(n: int, capacity: int = CAPACITY, classes: int = CLASSES) -> list[tuple[int, int]]:
    """(length, class) of the pieces of a document of n tokens, in order."""
    out = [(capacity, 1)] * (n // capacity)
    r = n % capacity
    while r:
        j = capacity // r
        if j >= classes or capacity - j * r <= capacity // 64:
            out.append((r, min(j, classes)))
            break
        out.append((capacity // (j + 1), j + 1))
        r -= capacity // (j + 1)
    return out


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in printable else next(others)) for b in range(256)]


def _kind(tokenizer) -> list[str]:
    """Its normalisers and pre-tokenizers, by name."""
    spec = json.loads(tokenizer.to_str())
    parts = [spec["normalizer"] or {}, spec["pre_tokenizer"] or {}]
    return [x["type"] for p in parts for x in p.get("normalizers", p.get("pretokenizers", [p])) if x]


def word_ids(tokenizer_path: str) -> Callable[[str], bytes]:
    """Text to its ids as little-endian 32-bit bytes, by a cache of space-separated words.

    The tokenizer must drop white space and never join across it, so that words can be encoded one by one.
    Plain words (Latin letters alone) skip its normaliser and splitter, which leave them as they are but for
    case, and go to its merges at once.
    """
    from tokenizers import Tokenizer

    kept = worker_cache(f"words:{tokenizer_path}")
    if "tokenizer" not in kept:
        kept |= {"tokenizer": (t := Tokenizer.from_file(tokenizer_path)), "ids": {}}
        if _kind(t) != ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"]:
            raise ValueError("words can only be encoded one by one for a tokenizer that lowers case and drops white space")
    tokenizer, ids, letters = kept["tokenizer"], kept["ids"], byte_letters()
    merges = tokenizer.model.tokenize

    def plain(word: str) -> bool:
        return word.isalpha() and max(word) < "\u0180"

    def core(word: str) -> tuple[str, str]:
        """A plain stem (also in lower case) and the mark after it are always apart, and its case is ignored."""
        mark = word[-1:] if word[-1:] in (".", ",") else ""
        stem = word[: len(word) - len(mark)]
        return (low, mark) if plain(stem) and plain(low := stem.lower()) else (word, "")

    def learn(words: list[str]) -> None:
        parts = [core(w) for w in words]
        odd = []
        for p in parts:
            for x in p:
                if x and x not in ids:
                    if plain(x) and x.islower():
                        y = [t.id for t in merges(x if x.isascii() else "".join([letters[b] for b in x.encode()]))]
                        ids[x] = struct.pack(f"<{len(y)}I", *y)
                    else:
                        odd.append(x)
        odd = list(dict.fromkeys(odd))
        for x, e in zip(odd, tokenizer.encode_batch_fast(odd, add_special_tokens=False), strict=True):
            y = e.ids
            ids[x] = struct.pack(f"<{len(y)}I", *y)
        ids.setdefault("", b"")
        for w, (stem, mark) in zip(words, parts, strict=True):
            ids[w] = ids[stem] + ids[mark] if mark else ids[stem]

    def encode(text: str) -> bytes:
        words = text.replace("\n", " ").split(" ")
        new = [w for w in dict.fromkeys(words) if w not in ids]
        if new:
            if len(ids) > CACHED_WORDS:
                ids.clear()
                new = list(dict.fromkeys(words))
            learn(new)
        return b"".join(map(ids.__getitem__, words))

    return encode


def _pack(tokenizer: str | None, capacity: int, classes: int) -> Callable:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        path = tokenizer
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        encode = word_ids(path)
        end = np.asarray([END_ID], "<u4").tobytes()
        task, opened = TaskContext.get().partitionId(), 0
        base = (task + 1) << 32
        bins: dict[int, list] = {j: [] for j in range(1, classes + 1)}
        out: list[tuple] = []

        def flush(rows):
            kinds = (pa.int64(),) * 5 + (pa.int32(),) + (pa.int64(),) * 3
            names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "sequence_id", "offset", "task")
            columns = zip(*rows, strict=True) if rows else [()] * 9
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=list(names))

        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = (encode(text) if text else b"") + end
                n, at = len(ids) // 4, 0
                for length, j in cut(n, capacity, classes):
                    bins[j].append((doc, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]), n, j))
                    at += length
                    if len(bins[j]) == j:
                        offset = 0
                        for piece in bins[j]:
                            out.append((*piece, base + opened, offset, task))
                            offset += piece[2]
                        opened, bins[j] = opened + 1, []
            if len(out) > 20_000:
                yield flush(out)
                out = []
        yield flush(out + [(*piece, None, None, task) for left in bins.values() for piece in left])

    return pack


def _fill(capacity: int, level: int, last: bool) -> Callable:
    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        """Bins of each class filled with its number of pieces; the last node packs the rest longest first, each into the first bin with room."""
        node = int(rows["node"].iloc[0])
        rows = rows.sort_values(["class", "doc_id", "start", "length", "ids_crc32"], kind="stable").reset_index(drop=True)
        j = rows["class"].to_numpy("int64")
        length = rows["length"].to_numpy("int64")
        rank = rows.groupby("class").cumcount().to_numpy()
        full = rank // j < rows.groupby("class")["class"].transform("size").to_numpy() // j
        new = full & (rank % j == 0)
        base = (1 << 56) + (level << 52) + (node << 20)
        bin_, before = np.cumsum(new) - 1, np.cumsum(np.where(full, length, 0)) - length
        offset = np.where(full, before - np.maximum.accumulate(np.where(new, before, 0)), 0)
        seq = np.where(full, base + bin_, -1)
        if last:
            room: list[int] = []
            left = np.flatnonzero(~full)
            for i in left[np.argsort(-length[left], kind="stable")].tolist():
                k = next((k for k, r in enumerate(room) if r >= length[i]), len(room))
                if k == len(room):
                    room.append(capacity)
                seq[i], offset[i] = (1 << 60) + k, capacity - room[k]
                room[k] -= int(length[i])
        return rows.assign(sequence_id=pd.Series(seq, dtype="Int64").mask(seq < 0), offset=offset, node=node // FANOUT)

    return fill


def harmonic_pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, classes: int = CLASSES) -> DataFrame:
    """The pieces of all docs with the sequence and the offset each has been given."""
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_pack(tokenizer, capacity, classes), PIECES)
    pieces = staged(pieces, "pieces")
    out = pieces.filter("sequence_id is not null").drop("task")
    left = pieces.filter("sequence_id is null").withColumn("node", F.floor(F.col("task") / FANOUT)).drop("task")
    nodes, level = (pieces.agg(F.max("task")).first()[0] or 0) // FANOUT, 0
    while True:
        filled = left.groupBy("node").applyInPandas(_fill(capacity, level, not nodes), PIECES.replace("task", "node"))
        if not nodes:
            return out.unionByName(filled.drop("node"))
        filled = staged(filled, "filled")
        out = out.unionByName(filled.filter("sequence_id is not null").drop("node"))
        left, nodes, level = filled.filter("sequence_id is null"), nodes // FANOUT, level + 1


def op3_pack_harmonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harmonic_pack(table(spark, sf_dir, "documents")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


QUERIES = {"op3_pack_harmonic": op3_pack_harmonic}
ORACLES: dict[str, str] = {}
