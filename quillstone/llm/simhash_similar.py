"""Near-duplicates of a stated similarity by long SimHash fingerprints and the binary-trie self-join.

64 bits tell texts apart that share nearly all shingles; at a Jaccard similarity of 0.8 two fingerprints differ in
some 15 % of their bits. Here a text has 1024 bits over its set of shingles, and these only find candidates.
Bands of bits deal fingerprints into buckets. Bands are as wide as the number of texts asks for (14 bits up to 4 million, two
more for each fourfold), so that a bucket holds some hundred unrelated texts at any size, and as many that of pairs at 0.8 all
but 0.05 % share one (73 of 14 bits; independent bits assumed). In a bucket node pairs of the trie over the first 64 bits are walked down under an error
budget, and pairs of leaves accepted that differ in up to four standard deviations more bits than the similarity has on
average. The first round carries 128 bits and only tells which fingerprints have any partner; the second deals those with
all bits. Tasks return spanning forests, whose components hold the candidates. In each component
all pairs within that limit that are not yet joined are verified by their exact sets of shingle hashes; a large
component is cut into blocks and every pair of blocks is a group of its own. Equal fingerprints are collapsed before.

Defined results: texts without words are equal; a null id is never a component's name unless all its members have none. The
deduplicating form decides by rows: of each component one row stays, that of the smallest id (of rows of one id, and of rows
without id if there are no others, any one). An empty table gives no rows; further columns, whatever their names, are kept.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, by_number, numbered, staged
from .components import connected_components
from .simhash import CHUNK, named_components, shingle_hashes, trie_join

WORDS, BAND, SHINGLE, SIMILARITY = 16, 14, 5, 0.8
#: Share of pairs at the similarity that may have no band in common; unrelated texts in a bucket, as a power of two.
MISSED, FILL = 0.0005, 8
#: Bits over the mean of the similarity, in standard deviations, of all bits and of the trie's 64; fingerprints of one
#: component that are verified together.
DEVIATIONS, PRUNED, TOGETHER = 4, 3.7, 2000
# Odd multipliers that make further hashes of one hash.
ODD = np.array([(0x9E3779B97F4A7C15 * (2 * k + 1)) & ((1 << 64) - 1) for k in range(WORDS)], np.uint64)


def differing(similarity: float, bits: int = 64 * WORDS, deviations: float = 1) -> int:
    """Bits in which texts of this Jaccard similarity differ, with standard deviations on top."""
    cosine = 2 * similarity / (1 + similarity)
    share = math.acos(min(1.0, cosine)) / math.pi
    return int(bits * share + deviations * math.sqrt(bits * share * (1 - share)))


def shingle_set(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    parts = list(shingle_hashes(text, size))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def long_simhash(text: bytes | None, size: int = SHINGLE) -> bytes:
    """1024 bits over the set of shingles, as bytes."""
    votes, n = np.zeros(64 * WORDS, np.int64), 0
    h = shingle_set(text, size)
    for k in range(0, len(h), 255):  # sums of up to 255 bits fit a byte
        x = h[k : k + 255, None] * ODD
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        votes += np.add.reduce(np.unpackbits(x.view(np.uint8), axis=1), axis=0, dtype=np.uint8)
        n += len(x)
    return np.packbits(2 * votes > n).tobytes()


def _fingerprints(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), pa.array([long_simhash(t, size) for t in b.column("text").to_pylist()], pa.binary())], names=["doc_id", "row", "fp"])

    return run


def bands(n: int, similarity: float, band: int = BAND) -> list[np.ndarray]:
    """The bits of each band, for n fingerprints: pieces of the bits in their order, then of seeded shuffles of them."""
    width = max(band, math.ceil(math.log2(max(2, n))) - FILL)
    share = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    count = math.ceil(math.log(MISSED) / math.log1p(-((1 - share) ** width)))
    out, rng, bits = [], np.random.default_rng(width), np.arange(64 * WORDS)
    while len(out) < count:
        out += [bits[k : k + width] for k in range(0, len(bits) - width + 1, width)]
        bits = rng.permutation(64 * WORDS)
    return out[:count]


def _deal(of: list[np.ndarray], whole: bool) -> Callable:
    """A row for each band: its bucket, the first 64 bits, and the next 64 or, in the second round, all bits."""
    count, width = len(of), len(of[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 1000):
                fps = b.column("fp").slice(s, 1000)
                n = len(fps)
                bits = np.frombuffer(b"".join(fps.to_pylist()), np.uint8).reshape(n, -1)
                single = np.unpackbits(bits, axis=1)[:, np.concatenate(of)].reshape(n, count, width)
                band = np.zeros((n, count), np.int64)
                for i in range(width):
                    band = band << 1 | single[:, :, i]
                band += np.arange(count) << width
                uid, first = b.column("uid").slice(s, 1000).to_numpy(), np.ascontiguousarray(bits[:, :8]).view(np.int64)[:, 0]
                more = fps.take(pa.array(np.repeat(np.arange(n), count))) if whole else pa.array(np.repeat(np.ascontiguousarray(bits[:, 8:16]).view(np.int64)[:, 0], count))
                yield pa.RecordBatch.from_arrays([pa.array(band.ravel()), pa.array(np.repeat(uid, count)), pa.array(np.repeat(first, count)), more], names=["bucket", "uid", "first", "fp" if whole else "second"])

    return run


def _join(limit: int, budget: int, all_bits: bool) -> Callable:
    """Rows come sorted by bucket. Over 128 bits: (u, u) of all that have a partner; over all: a spanning forest of links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def joined(t: pa.Table) -> pa.RecordBatch:
            bucket, uid, keys = (t.column(c).to_numpy() for c in ("bucket", "uid", "first"))
            keys = keys.view(np.uint64)
            order = np.lexsort((uid, keys, bucket))
            bucket, uid, keys = bucket[order], uid[order], keys[order]
            if all_bits:
                words = np.frombuffer(b"".join(t.column("fp").to_pylist()), np.uint64).reshape(-1, WORDS)
            else:
                words = np.stack([t.column("first").to_numpy(), t.column("second").to_numpy()], 1).view(np.uint64)

            def accept(u, v):
                out = [np.bitwise_count(words[order[u[k : k + 100_000]]] ^ words[order[v[k : k + 100_000]]]).sum(1) <= limit for k in range(0, len(u), 100_000)]
                return np.concatenate(out) if out else np.zeros(0, bool)

            labels = trie_join(keys, bucket, budget, accept)
            linked = np.flatnonzero(labels != np.arange(len(labels)))
            u, v = uid[linked], uid[labels[linked]]
            if not all_bits:
                u = v = np.unique(np.concatenate([u, v]))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        held: list[pa.RecordBatch] = []
        for b in batches:
            if b.num_rows:
                held.append(b)
            if sum(x.num_rows for x in held) >= CHUNK:
                t = pa.Table.from_batches(held).combine_chunks()
                bucket = t.column("bucket").to_numpy()
                whole = int(np.searchsorted(bucket, bucket[-1]))
                if whole:
                    yield joined(t.slice(0, whole))
                held = t.slice(whole).to_batches()
        if held:
            yield joined(pa.Table.from_batches(held))

    return run


def _sets(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = pa.array([shingle_set(t, size).tobytes() for t in b.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("root"), b.column("fp"), sets], names=["uid", "root", "fp", "shingles"])

    return run


def verified_labels(fps: np.ndarray, sets: list[np.ndarray], block: np.ndarray, limit: int, similarity: float) -> np.ndarray:
    """For each row the first of its component by pairs whose sets have the similarity; of two blocks only pairs across."""
    labels, across = np.arange(len(fps)), len(np.unique(block)) > 1
    for a in range(len(fps) - 1):
        rest = a + 1 + np.flatnonzero((labels[a + 1 :] != labels[a]) & ((block[a + 1 :] != block[a]) | (not across)))
        for b in rest[np.bitwise_count(fps[rest] ^ fps[a]).sum(1) <= limit].tolist():
            if labels[a] == labels[b]:
                continue
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) < similarity * max(len(x), len(y)) - 1e-9:
                continue
            common = len(np.intersect1d(x, y, assume_unique=True))
            if common >= similarity * (len(x) + len(y) - common) - 1e-9:
                low, high = sorted((labels[a], labels[b]))
                labels[labels == high] = low
    return labels


def _verify(limit: int, similarity: float) -> Callable:
    """Rows come sorted by group (root, i, j); a spanning forest of the links of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def forest(rows: list[tuple]) -> pa.RecordBatch:
            uid, block, fps, sets = zip(*rows, strict=True)
            uid = np.array(uid, np.int64)
            labels = verified_labels(np.frombuffer(b"".join(fps), np.uint64).reshape(-1, WORDS), [np.frombuffer(x, np.uint64) for x in sets], np.array(block), limit, similarity)
            linked = np.flatnonzero(labels != np.arange(len(labels)))
            return pa.RecordBatch.from_arrays([pa.array(uid[linked]), pa.array(uid[labels[linked]])], names=["u", "v"])

        now, held = None, []
        for b in batches:
            for root, i, j, *row in zip(*(b.column(c).to_pylist() for c in ("root", "i", "j", "uid", "block", "fp", "shingles")), strict=True):
                if (root, i, j) != now:
                    if len(held) > 1:
                        yield forest(held)
                    now, held = (root, i, j), []
                held.append(row)
        if len(held) > 1:
            yield forest(held)

    return run


def _verified(docs: DataFrame, candidates: DataFrame, size: int, similarity: float, together: int) -> DataFrame:
    """(u, v) over uid: a graph with the components of all pairs of candidates (uid, row, fp, root) of the similarity or more."""
    # Only candidates' texts are moved.
    rows = by_number(docs, candidates, keep=True).select(F.col(ROW).alias("row"), F.encode(F.col("text").cast("string"), "UTF-8").alias("text"))
    texts = rows.join(candidates, "row").select("uid", "root", "fp", "text")
    sets = staged(texts.mapInArrow(_sets(size), "uid long, root long, fp binary, shingles binary"), "sets")
    blocks = candidates.groupBy("root").agg(F.ceil(F.count("*") / together).cast("int").alias("blocks"))
    sets = sets.join(blocks, "root").withColumn("block", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int"))
    met = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "uid", "block", "fp", "shingles")
    met = met.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    return met.mapInArrow(_verify(differing(similarity, deviations=DEVIATIONS), similarity), "u long, v long")


def _grouped(docs: DataFrame, size: int, similarity: float, together: int) -> DataFrame:
    """doc_id, row, fp, n, component_id, keeper of numbered docs (doc_id, text)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(ROW).alias("row"), F.encode(F.col("text").cast("string"), "UTF-8").alias("text"))
    rows = staged(texts.mapInArrow(_fingerprints(size), "doc_id long, row long, fp binary"), "fingerprints")
    keeper = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"), F.min(keeper).alias("keeper"))
    distinct = staged(distinct.withColumn("uid", F.monotonically_increasing_id()), "distinct")
    of, budget = bands(distinct.count(), similarity), differing(similarity, 64, PRUNED)
    dealt = distinct.select("uid", "fp").mapInArrow(_deal(of, False), "bucket long, uid long, first long, second long")
    partners = dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_join(differing(similarity, 128, DEVIATIONS), budget, False), "u long, v long").select(F.col("u").alias("uid")).distinct()
    partners = staged(distinct.join(partners, "uid", "left_semi").select("uid", "fp"), "partners")
    dealt = partners.mapInArrow(_deal(of, True), "bucket long, uid long, first long, fp binary")
    links = dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_join(differing(similarity, deviations=DEVIATIONS), budget, True), "u long, v long")
    near = connected_components(links).select(F.col("node").alias("uid"), "root")
    candidates = staged(distinct.join(near, "uid").select("uid", F.col("keeper.row").alias("row"), "fp", "root"), "candidates")
    links = _verified(docs, candidates, size, similarity, together)
    roots = connected_components(links).select(F.col("node").alias("uid"), "root")
    return named_components(rows, distinct, roots)


def similar_documents(docs: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY, together: int = TOGETHER) -> DataFrame:
    """doc_id, component_id (the smallest doc_id reachable by links of the similarity or more) of every row of docs."""
    out = _grouped(numbered(docs.select("doc_id", "text")), size, similarity, together)
    return out.select("doc_id", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def deduplicate_similar(docs: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY, together: int = TOGETHER) -> DataFrame:
    """docs, in its own columns, with one row of each component."""
    docs = numbered(docs)
    out = _grouped(docs.select("doc_id", ROW, "text"), size, similarity, together)
    return by_number(docs, out.filter("row <> keeper.row"), keep=False).drop(ROW)
