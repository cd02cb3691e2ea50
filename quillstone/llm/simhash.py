"""SimHash near-duplicates by a binary-trie self-join within pigeonhole buckets.

Equal fingerprints are collapsed first, so copies never meet in the join. Two fingerprints that differ
in at most 4 bits agree on one of 5 blocks of bits; every distinct fingerprint goes to its 5 block buckets.
A bucket that holds over `hot` fingerprints is dealt again by 5 blocks of its other bits, which keeps all
links. In a bucket, fingerprints in sorted order are the leaves of a binary trie: pairs of nodes are
walked down together, a pair of differing branches costs one bit, and pairs over the budget are dropped, as are
pairs whose members are already in one component. A task returns a spanning forest of what it found,
never pairs of whole groups, and forests are united by connected components over fingerprints.

Defined results: a text without words has fingerprint zero, and those link like any other; a null id
is never a component's name unless all members have none (then it is null); the report keeps repeated ids. The
deduplicating form decides by rows: of each component one row stays, that of the smallest id (of rows of one id, and of
rows without id if there are no others, any one). An empty table gives no rows; further columns, whatever their names,
are ignored by the report and kept by the deduplicating form.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW, by_number, numbered, staged, table
from .components import connected_components, join_hot, merge_labels

SHINGLE, BITS, BUDGET, SEED, HOT = 4, 64, 4, 42, 100_000
#: Node pairs with at most so many pairs of leaves are compared outright; a step takes so many node pairs, and compares so many leaves.
LEAF, STEP, PAIRS = 256, 100_000, 1_000_000
#: Rows that are joined together at least, if there are as many.
CHUNK = 200_000


def shingle_hashes(text: bytes | None, size: int) -> Iterator[np.ndarray]:
    """XXH64 of all shingles, in parts; bytes.lower() and bytes.split() know ASCII letters and white space alone."""
    import xxhash

    words = text.lower().split() if text else []
    if not words:
        return
    size = min(size, len(words))
    joined = b" ".join(words)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    begin, end = (ends - lens)[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()
    for k in range(0, len(begin), 50_000):
        shingles = [joined[a:b] for a, b in zip(begin[k : k + 50_000], end[k : k + 50_000], strict=True)]
        yield np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), "<u8", len(shingles))


def simhash(text: bytes | None, size: int = SHINGLE) -> int:
    """The 64-bit fingerprint over all shingles, as a signed number; zero without words."""
    votes, n = np.zeros(BITS, np.int64), 0
    for h in shingle_hashes(text, size):
        votes += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, BITS).sum(0, dtype=np.int64)
        n += len(h)
    return int.from_bytes(np.packbits(2 * votes > n, bitorder="little").tobytes(), "little", signed=True)


def _fingerprints(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), pa.array([simhash(t, size) for t in b.column("text").to_pylist()], pa.int64())], names=["doc_id", "row", "fp"])

    return run


def trie_join(keys: np.ndarray, buckets: np.ndarray, budget: int = BUDGET, accept: Callable | None = None) -> np.ndarray:
    """For each key (unsigned, sorted within its bucket) the index of the first key of its component.

    accept may refuse pairs within the budget, given their indexes.
    """
    n = len(keys)
    labels = np.arange(n)
    if accept is None and n:  # equal keys are links
        labels = np.maximum.accumulate(np.where(np.concatenate([[True], (keys[1:] != keys[:-1]) | (buckets[1:] != buckets[:-1])]), labels, 0))
    edges = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1], [True]]))
    lo, hi = edges[:-1], edges[1:]
    zero = np.zeros(len(lo), np.int64)
    stack = [(0, np.stack([lo, hi, lo, hi, zero]))]
    ones: dict[int, np.ndarray] = {}
    while stack:
        depth, nodes = stack.pop()
        if nodes.shape[1] > STEP:
            stack += [(depth, nodes[:, k : k + STEP]) for k in range(0, nodes.shape[1], STEP)]
            continue
        changes = np.concatenate([[0], np.cumsum(labels[1:] != labels[:-1])])
        a0, a1, b0, b1, err = nodes
        joined = (changes[a0] == changes[a1 - 1]) & (changes[b0] == changes[b1 - 1]) & (labels[a0] == labels[b0])
        nodes = nodes[:, ~joined]
        a0, a1, b0, b1, err = nodes
        small = ((a1 - a0) * (b1 - b0) <= LEAF) | (depth >= BITS)
        wide = small & ((a1 - a0) * (b1 - b0) > PAIRS) & (a1 - a0 > 1)
        if wide.any():
            # Many leaves of one key: a few against all first, and the rest again if that has not joined them.
            for x0, x1, y0, y1, e in nodes[:, wide].T.tolist():
                cut = x0 + max(1, PAIRS // (y1 - y0))
                stack += [(depth, np.array([[cut], [x1], [y0], [y1], [e]])), (depth, np.array([[x0], [cut], [y0], [y1], [e]]))]
            nodes, small = nodes[:, ~wide], small[~wide]
            a0, a1, b0, b1, err = nodes
        labels = _leaves(keys, labels, nodes[:, small], budget, accept)
        nodes = nodes[:, ~small]
        if not nodes.shape[1]:
            continue
        a0, a1, b0, b1, err = nodes
        if depth not in ones:
            ones[depth] = np.concatenate([[0], np.cumsum((keys >> np.uint64(BITS - 1 - depth)) & np.uint64(1), dtype=np.int64)])
        c = ones[depth]
        am, bm = a1 - (c[a1] - c[a0]), b1 - (c[b1] - c[b0])
        same = (a0 == b0) & (a1 == b1)
        down = [np.stack([a0, am, b0, bm, err]), np.stack([am, a1, bm, b1, err]), np.stack([a0, am, bm, b1, err + 1]), np.stack([am, a1, b0, bm, err + 1])[:, ~same]]
        down = np.concatenate(down, 1)
        stack.append((depth + 1, down[:, (down[0] < down[1]) & (down[2] < down[3]) & (down[4] <= budget)]))
    return labels


def _leaves(keys: np.ndarray, labels: np.ndarray, nodes: np.ndarray, budget: int, accept: Callable | None) -> np.ndarray:
    for k in range(0, nodes.shape[1], 16_000):
        a0, a1, b0, b1, _ = nodes[:, k : k + 16_000]
        sizes = (a1 - a0) * (b1 - b0)
        which = np.repeat(np.arange(len(sizes)), sizes)
        at = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        width = (b1 - b0)[which]
        u, v = a0[which] + at // width, b0[which] + at % width
        near = (u != v) & (np.bitwise_count(keys[u] ^ keys[v]) <= budget) & (labels[u] != labels[v])
        u, v = u[near], v[near]
        if accept is not None:
            good = accept(u, v)
            u, v = u[good], v[good]
        labels = merge_labels(labels, u, v)
    return labels


def _joiner(budget: int) -> Callable:
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket and key; whole buckets are joined, many at a time."""
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def forest(buckets, fps):
            keys = fps.view(np.uint64)
            order = np.lexsort((keys, buckets))
            keys, buckets = keys[order], buckets[order]
            labels = trie_join(keys, buckets, budget)
            linked = np.flatnonzero(labels != np.arange(len(labels)))
            return pa.RecordBatch.from_arrays([pa.array(keys[linked].view(np.int64)), pa.array(keys[labels[linked]].view(np.int64))], names=["u", "v"])

        for b in batches:
            held.append((b.column("bucket").to_numpy(), b.column("fp").to_numpy()))
            if sum(len(x) for x, _ in held) >= CHUNK:
                buckets, fps = (np.concatenate(x) for x in zip(*held, strict=True))
                whole = int(np.searchsorted(buckets, buckets[-1]))
                if whole:
                    yield forest(buckets[:whole], fps[:whole])
                held = [(buckets[whole:], fps[whole:])]
        if held:
            yield forest(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return join


def _block(column, start: int, width: int):
    return F.shiftrightunsigned(column, start).bitwiseAND(F.lit((1 << width) - 1))


def _ranges(bits: list[int], parts: int) -> list[list[int]]:
    return [list(map(int, x)) for x in np.array_split(bits, parts)]


def link_fingerprints(fps: DataFrame, budget: int = BUDGET, hot: int = HOT) -> DataFrame:
    """(u, v) over distinct fingerprints fp: a graph with the components of all links within the budget."""
    blocks = _ranges(list(range(BITS)), budget + 1)
    key = F.col("fp")
    of = [F.lit(i << 48).bitwiseOR(_block(key, r[0], len(r))) for i, r in enumerate(blocks)]
    dealt = staged(fps.select("fp", F.posexplode(F.array(*of)).alias("block", "bucket")), "dealt")
    full = dealt.groupBy("bucket").count().filter(F.col("count") > hot).select("bucket")
    # Over 5 n fingerprints at most 5 n / hot buckets are hot.
    plain = dealt.join(full, "bucket", "left_anti").select("bucket", "fp")
    again = None
    for i, r in enumerate(blocks):
        others = _ranges([b for b in range(BITS) if b not in r], budget + 1)
        values = []
        for j, bits in enumerate(others):
            runs, value = [], F.lit(0).cast("long")
            for bit in bits:
                if runs and runs[-1][0] + runs[-1][1] == bit:
                    runs[-1][1] += 1
                else:
                    runs.append([bit, 1])
            for start, width in runs:
                value = F.shiftleft(value, width).bitwiseOR(_block(key, start, width))
            values.append(F.xxhash64("bucket", F.lit(j), value))
        part = dealt.filter(F.col("block") == i).join(full, "bucket", "left_semi").select(F.explode(F.array(*values)).alias("bucket"), "fp")
        again = part if again is None else again.unionByName(part)
    rows = plain.unionByName(again).repartition("bucket").sortWithinPartitions("bucket")
    return rows.mapInArrow(_joiner(budget), "u long, v long")


def named_components(rows: DataFrame, distinct: DataFrame, roots: DataFrame) -> DataFrame:
    """rows (with fp) with n, component_id and keeper; n is null where a row is alone.

    distinct has uid, fp, first (its smallest id), keeper (its first row by id, rows without id last) and n; roots has the root of
    each linked uid.
    """
    rooted = staged(distinct.join(roots, "uid", "left").withColumn("root", F.coalesce("root", "uid")).drop("uid"), "rooted")
    names = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.min("keeper").alias("keeper"), F.count("*").alias("members"))
    # Only fingerprints that are shared or linked need more than their own row.
    named = join_hot(rooted.drop("keeper"), names, "root", rooted.count(), "members").filter("n > 1 or members > 1").select("fp", "n", "component_id", "keeper")
    return join_hot(rows, named, "fp", rows.count())


def _grouped(rows: DataFrame, size: int, budget: int, hot: int) -> DataFrame:
    """doc_id, row, fp, n, component_id, keeper of rows (doc_id, row, text)."""
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "row", F.encode(F.col("text").cast("string"), "UTF-8").alias("text"))
    rows = staged(rows.mapInArrow(_fingerprints(size), "doc_id long, row long, fp long"), "fingerprints")
    keeper = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    distinct = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.min(keeper).alias("keeper"), F.count("*").alias("n")), "distinct")
    roots = connected_components(link_fingerprints(distinct.select("fp"), budget, hot)).select(F.col("node").alias("uid"), "root")
    return named_components(rows, distinct.withColumn("uid", F.col("fp")), roots)


def near_duplicates(docs: DataFrame, size: int = SHINGLE, budget: int = BUDGET, hot: int = HOT) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable) of every row of docs."""
    out = _grouped(docs.select("doc_id", F.lit(0).cast("long").alias("row"), "text"), size, budget, hot)
    return out.select("doc_id", "fp", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def deduplicate(docs: DataFrame, size: int = SHINGLE, budget: int = BUDGET, hot: int = HOT) -> DataFrame:
    """docs, in its own columns, with one row of each component."""
    docs = numbered(docs)
    out = _grouped(docs.select("doc_id", F.col(ROW).alias("row"), "text"), size, budget, hot)
    return by_number(docs, out.filter("row <> keeper.row"), keep=False).drop(ROW)


def op9_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op9_simhash_trie": op9_simhash_trie}
ORACLES: dict[str, str] = {}
