"""Search over embedding tables by tiles of queries and rows, an inverted-file index, and how good a ranking is.

Queries are dealt into chunks and rows into groups; each pair of a chunk and a group is a tile, which is one
task's work and bounded whatever the numbers of either. Nothing passes through the driver but counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import shared_folder
from .ranking import top_k

#: Queries and rows of a tile, at most about; scores held at a time; chunks of queries that one job takes.
QUERIES, ROWS, SCORES, FAN_IN = 16_384, 32_768, 1 << 22, 64
#: Relevant rows that a chunk of queries counts for, about.
ENTRIES = 4_000_000
#: Rows that an inverted file's centres are fitted on, for each centre; the most centres.
SAMPLE, CELLS = 64, 4096


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _filled(df: DataFrame) -> DataFrame:
    return df.filter("vector is not null and size(vector) > 0")


def _groups(n: int, size: int, spark) -> int:
    """Groups for n rows: of at most `size`, and small tables still over several tasks."""
    return max(1, -(-n // size), min(2 * spark.sparkContext.defaultParallelism, n // 2048))


def _place(n: int) -> Column:
    """Even groups for any ids, repeated ones too: by the place of the row, not by its id."""
    return F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int")


def _every(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def best_of_tile(k: int, skip_self: bool, least: float | None) -> Callable:
    """The k best rows of a tile for each of its queries; of equal scores the smaller ids."""

    def run(q: pa.Table, v: pa.Table) -> pa.Table:
        ids, own = q.column("query_id").to_numpy(), v.column("id").to_numpy()
        order = np.argsort(own, kind="stable")
        own, rows, asked = own[order], _matrix(v.column("vector"))[order], _matrix(q.column("asked"))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        step = max(1, SCORES // max(1, len(own)))
        for at in range(0, len(ids) if len(own) else 0, step):
            block = ids[at : at + step]
            sims = asked[at : at + step] @ rows.T
            if skip_self:
                sims[block[:, None] == own[None, :]] = -np.inf
            n = min(k, sims.shape[1])
            bar = np.partition(sims, -n, axis=1)[:, -n][:, None]
            above, level = sims > bar, sims == bar
            # Rows are in the order of their ids, so the first ones at the bar fill what is left.
            keep = above | level & (np.cumsum(level, axis=1) <= n - above.sum(axis=1, keepdims=True))
            keep &= sims > (-np.inf if least is None else least)
            a, b = np.nonzero(keep)
            out.append((block[a], own[b], sims[a, b]))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(columns, ["query_id", "id", "score"])

    return run


def nearest(queries: DataFrame, vectors: DataFrame, k: int, skip_self: bool = True, least: float | None = None) -> DataFrame:
    """query_id, id, score, rank of the k best of vectors (id, vector) by inner product for each of queries (id, vector).

    Queries go to every group of rows and rows to every chunk of queries. Each tile gives at most k rows a query,
    of which each task keeps k before they are shuffled. Queries of one id share their k; nulls take no part.
    """
    spark = vectors.sparkSession
    queries, vectors = _filled(queries).select(F.col("id").alias("query_id"), F.col("vector").alias("asked")), _filled(vectors.select("id", "vector"))
    chunks, groups = max(1, -(-queries.count() // QUERIES)), _groups(vectors.count(), ROWS, spark)
    q = queries.withColumn("chunk", _place(chunks)).withColumn("group", _every(groups))
    v = vectors.withColumn("group", _place(groups)).withColumn("chunk", _every(chunks))
    found = q.groupBy("chunk", "group").cogroup(v.groupBy("chunk", "group")).applyInArrow(best_of_tile(k, skip_self, least), "query_id long, id long, score double")
    return top_k(found, ["query_id"], k, F.desc("score"), "id")


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of a and b, each summed in the order of its components, so that a pair's score never depends on its tile."""
    out, b = np.multiply.outer(a[:, 0], b[:, 0]), np.ascontiguousarray(b.T)
    for j in range(1, a.shape[1]):
        out += a[:, j : j + 1] * b[j]
    return out


def _packed(numbers: str) -> Callable:
    """Rows (id, kind, vector) with the vector as the bytes of its numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            rows = [v.tobytes() for v in _matrix(pa.chunked_array([x.column("vector")])).astype(numbers)]
            yield pa.RecordBatch.from_arrays([x.column("id"), x.column("kind"), pa.array(rows, pa.binary())], ["id", "kind", "vector"])

    return run


def _unpacked(column: pa.Array, numbers: str) -> np.ndarray:
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(numbers).reshape(len(column), -1).astype(np.float64)


def _places(keys: np.ndarray, names: np.ndarray, mine: np.ndarray, own: np.ndarray) -> np.ndarray:
    """How many of the entries (keys, then names, in order) do not stand behind each row (mine, own)."""
    at = np.searchsorted(keys, mine, "left")
    tied = np.flatnonzero(keys[np.minimum(at, len(keys) - 1)] == mine)
    size = np.searchsorted(keys, mine[tied], "right") - at[tied]
    one, many = tied[size == 1], tied[size > 1]
    at[one] += names[at[one]] <= own[one]
    many = many[np.argsort(at[many], kind="stable")]
    for rows in np.split(many, np.flatnonzero(np.diff(at[many])) + 1) if len(many) else []:  # entries of one score go by their ids
        first = at[rows[0]]
        at[rows] += np.searchsorted(names[first : np.searchsorted(keys, keys[first], "right")], own[rows], "right")
    return at


def _dealt(ids: np.ndarray, parts: int) -> np.ndarray:
    return (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(parts)


def _judged(parts: int, numbers: str) -> Callable:
    """query_id, share, first, ranks, n of the units of one chunk, from its units, then all rows, then all rows again (step 0, 1, 2).

    The first pass keeps the scores and ids of each unit's entries, the relevant rows of its part. The second counts how many rows, and
    how many relevant ones, stand before each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, want, part, held, entries = [], [], [], [], []
        asked = np.zeros((0, 0))
        for whole in batches:
            for step in range(3):
                x = whole.filter(pc.equal(whole.column("step"), step))
                if not len(x):
                    continue
                own, rows = x.column("id").to_numpy(), _unpacked(x.column("vector"), numbers)
                if step == 0:
                    query, want, part = query + own.tolist(), want + x.column("kind").to_pylist(), part + x.column("part").to_pylist()
                    held, asked = held + [[] for _ in own], np.concatenate([asked, rows]) if len(asked) else rows
                    continue
                known = x.column("kind").is_valid().to_numpy(zero_copy_only=False)
                kind = np.where(known, x.column("kind").fill_null(0).to_numpy(), 0)
                if step == 1:
                    for k in sorted({w for w in want if w is not None}):
                        at, some = np.flatnonzero((kind == k) & known), [i for i, w in enumerate(want) if w == k]
                        for i, keys in zip(some, -dots(asked[some], rows[at]) if len(at) else [], strict=len(at) > 0):
                            mine = (own[at] != query[i]) & (_dealt(own[at], parts) == part[i])
                            held[i].append((keys[mine], own[at][mine]))
                    continue
                if not entries:
                    for i, kept in enumerate(held):
                        keys, names = (np.concatenate(c) for c in zip(*kept, strict=True)) if kept else (np.zeros(0), np.zeros(0, np.int64))
                        order, held[i] = np.lexsort((names, keys)), []
                        entries.append((keys[order], names[order], np.zeros(len(order) + 1, np.int64), np.zeros(len(order) + 1, np.int64)))
                filled, many = [i for i, e in enumerate(entries) if len(e[0])], max(1, SCORES // 64 // len(own))
                for some in (filled[i : i + many] for i in range(0, len(filled), many)):
                    for i, mine in zip(some, -dots(asked[some], rows), strict=True):
                        keys, names, before, hits = entries[i]
                        at, others = _places(keys, names, mine, own), own != query[i]
                        before += np.bincount(at[others], minlength=len(before))
                        hits += np.bincount(at[others & known & (kind == want[i])], minlength=len(hits))
        out: list[list] = [[], [], [], [], []]
        for q, (_, names, before, hits) in zip(query, entries):
            if len(names):
                rank, nth = np.cumsum(before)[:-1] + 1, np.cumsum(hits)[:-1] + 1
                for column, x in zip(out, (q, float(np.sum(nth / rank)), int(rank.min()), float(rank.sum()), len(rank)), strict=True):
                    column.append(x)
        kinds = (pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["query_id", "share", "first", "ranks", "n"])

    return run


def quality_by_counts(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """query_id, ap, mrr, auc, n_relevant of the ranking of all vectors (id, vector, kind) but itself for each of queries (id, vector, kind).

    Relevant are rows of the query's kind. No ranking is made: the rank of a relevant row is one more than the rows
    that stand before it (by score, then by id). A chunk of queries is one task, which reads all rows twice and holds about ENTRIES
    relevant rows; those of a query with too many are dealt by their ids over several units. Nothing that grows with queries times rows is
    written or shuffled: rows are written once, and the tasks read them, FAN_IN chunks a job.
    """
    spark, folder, form = vectors.sparkSession, shared_folder(vectors.sparkSession, "quality"), "id long, kind long, vector binary"
    numbers = "f4" if {x.schema["vector"].dataType.simpleString() for x in (queries, vectors)} == {"array<float>"} else "f8"
    packed = lambda x: _filled(x.select("id", "vector", F.col("kind").cast("long").alias("kind"))).select("id", "kind", "vector").mapInArrow(_packed(numbers), form)
    packed(vectors).write.parquet(f"{folder}/rows")
    packed(queries).write.parquet(f"{folder}/queries")
    rows, asked = (spark.read.schema(form).parquet(f"{folder}/{x}") for x in ("rows", "queries"))
    n, n_asked, kinds = rows.count(), asked.count(), rows.groupBy("kind").agg(F.count("*").alias("n"))
    total = asked.groupBy("kind").count().join(kinds, "kind").agg(F.coalesce(F.sum(F.col("count") * F.col("n")), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    parts = max(1, -(-total[1] // max(1, ENTRIES // 8)))
    # Small tables still over several tasks.
    chunks = max(1, -(-total[0] // ENTRIES), -(-n_asked * parts // QUERIES), min(2 * spark.sparkContext.defaultParallelism, n * n_asked // (2 * SCORES)))
    units = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    units = units.select(F.lit(0).alias("step"), "*").withColumn("chunk", F.pmod(F.xxhash64("id", "part"), F.lit(chunks)).cast("int"))

    def judged(chunk: int) -> DataFrame:
        passes = [rows.select(F.lit(step).alias("step"), "*", F.lit(0).alias("part")) for step in (1, 2)]
        in_order = reduce(DataFrame.union, [units.filter(F.col("chunk") == chunk).drop("chunk"), *passes]).coalesce(1).sortWithinPartitions("step")
        return in_order.mapInArrow(_judged(parts, numbers), "query_id long, share double, first long, ranks double, n long")

    # Spark puts the tasks of a union into one where each branch is a single task, so one more branch is a plain scan, without rows.
    none = rows.filter("vector IS NULL").select(F.col("id").alias("query_id"), F.lit(0.0).alias("share"), F.col("id").alias("first"), F.lit(0.0).alias("ranks"), F.col("id").alias("n"))
    for first in range(0, chunks, FAN_IN):
        reduce(DataFrame.union, [none, *(judged(c) for c in range(first, min(first + FAN_IN, chunks)))]).write.mode("append").parquet(f"{folder}/found")
    found = spark.read.schema("query_id long, share double, first long, ranks double, n long").parquet(f"{folder}/found")
    ids = asked.select(F.col("id").alias("query_id")).distinct()
    g = ids.join(found, "query_id", "left").groupBy("query_id").agg(*[F.sum(c).alias(c) for c in ("share", "ranks", "n")], F.min("first").alias("first"))
    inside = rows.select(F.col("id").alias("query_id")).distinct().withColumn("own", F.lit(1))
    pos = F.coalesce("n", F.lit(0))
    neg = F.lit(n) - F.coalesce("own", F.lit(0)) - pos
    before = pos * neg - (F.col("ranks") - pos * (pos + 1) / 2)
    auc = F.when((pos > 0) & (neg > 0), before / (pos * neg)).otherwise(0.0)
    return g.join(inside, "query_id", "left").select("query_id", F.coalesce(F.col("share") / F.col("n"), F.lit(0.0)).alias("ap"), F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)).alias("mrr"), auc.alias("auc"), pos.alias("n_relevant"))


def _centres(cells: int, rounds: int) -> Callable:
    def run(sample: pa.Table) -> pa.Table:
        rows = _matrix(sample.column("vector"))[np.argsort(sample.column("order").to_numpy(), kind="stable")]
        rows = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)
        centres = np.unique(rows, axis=0)
        centres = centres[np.random.default_rng(7).permutation(len(centres))[:cells]]
        for _ in range(rounds):
            cell = np.argmax(rows @ centres.T, axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, cell, rows)
            size = np.linalg.norm(sums, axis=1, keepdims=True)
            centres = np.where(size > 0, sums / np.maximum(size, 1e-300), centres)
        return pa.table([pa.array(range(len(centres)), pa.int32()), pa.array(list(centres), pa.list_(pa.float64()))], ["cell", "centre"])

    return run


def inverted_file(vectors: DataFrame, path: str, cells: int | None = None, rounds: int = 8) -> DataFrame:
    """Writes vectors (id, vector) under path/rows by cell, and the cells' centres (returned) under path/centres.

    The centres are fitted by spherical k-means on at most SAMPLE rows a cell, those of the smallest hashes; every row
    is indexed, in the cell of the centre with the greatest inner product. By default one cell for 39 rows, at most CELLS.
    """
    spark = vectors.sparkSession
    rows = _filled(vectors.select("id", "vector"))
    cells = cells or max(1, min(rows.count() // 39, CELLS))
    sample = rows.select("vector", F.xxhash64("id", "vector").alias("order")).orderBy("order").limit(SAMPLE * cells)
    fitted = sample.groupBy(F.lit(0).alias("all")).applyInArrow(_centres(cells, rounds), "cell int, centre array<double>")
    fitted.write.mode("overwrite").parquet(f"{path}/centres")
    centres = spark.read.schema("cell int, centre array<double>").parquet(f"{path}/centres")
    rows.withColumn("cell", F.element_at(cells_of(rows, centres, 1, "vector"), 1)).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    return centres


def cells_of(df: DataFrame, centres: DataFrame, probes: int, vector: str) -> Column:
    """The cells of the `probes` centres (at most CELLS, so they are broadcast) with the greatest inner products."""
    kept = centres.orderBy("cell").collect()
    names, matrix = np.array([r["cell"] for r in kept], np.int32), np.array([r["centre"] for r in kept])
    sent = df.sparkSession.sparkContext.broadcast((names, matrix))

    @F.pandas_udf("array<int>")
    def near(v: pd.Series) -> pd.Series:
        names, matrix = sent.value
        sims = np.stack(v.to_list()).astype(np.float64) @ matrix.T if len(v) else np.zeros((0, len(names)))
        return pd.Series(list(names[np.argsort(-sims, axis=1, kind="stable")[:, :probes]]))

    return near(vector)


def probe(queries: DataFrame, path: str, k: int, probes: int = 8, skip_self: bool = True) -> DataFrame:
    """query_id, id, score, rank: the k best for each of queries (id, vector) among the rows of the `probes` nearest cells of an inverted file.

    Only the folders of cells that some query asks for are read. A cell of many rows is dealt over several tiles, and so are
    the queries that ask for it.
    """
    spark = queries.sparkSession
    centres = spark.read.schema("cell int, centre array<double>").parquet(f"{path}/centres")
    asked = _filled(queries).select(F.col("id").alias("query_id"), F.col("vector").alias("asked"))
    asked = asked.withColumn("cell", F.explode(cells_of(asked, centres, probes, "asked")))
    wanted = {r["cell"]: r["n"] for r in asked.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # at most CELLS rows
    rows = spark.read.schema("id long, vector array<float>, cell int").parquet(f"{path}/rows").filter(F.col("cell").isin(sorted(wanted) or [-1]))
    sizes = {r["cell"]: r["n"] for r in rows.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    plan = spark.createDataFrame([(c, -(-wanted[c] // QUERIES), -(-n // ROWS)) for c, n in sizes.items()], "cell int, chunks int, groups int")
    mixed = F.abs(F.xxhash64(F.monotonically_increasing_id()))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    q = asked.withColumn("at", mixed).join(F.broadcast(plan), "cell").withColumn("chunk", F.pmod("at", "chunks").cast("int")).withColumn("group", every("groups"))
    v = rows.withColumn("at", mixed).join(F.broadcast(plan), "cell").withColumn("group", F.pmod("at", "groups").cast("int")).withColumn("chunk", every("chunks"))
    q, v = q.select("cell", "chunk", "group", "query_id", "asked"), v.select("cell", "chunk", "group", "id", "vector")
    keys = ["cell", "chunk", "group"]
    found = q.groupBy(*keys).cogroup(v.groupBy(*keys)).applyInArrow(best_of_tile(k, skip_self, None), "query_id long, id long, score double")
    return top_k(found, ["query_id"], k, F.desc("score"), "id")


def ranking_quality(ranked: DataFrame, query: str, rank: str, relevant: str) -> DataFrame:
    """query, ap, mrr, auc, n_relevant from full rankings: rank (1 is best, no ties) and relevant (boolean) of every item."""
    hit = F.when(F.col(relevant), F.col(rank))
    order = F.row_number().over(Window.partitionBy(query, relevant).orderBy(rank))
    with_hits = ranked.withColumn("__nth", order).withColumn("__rank", hit)
    g = with_hits.groupBy(query).agg(
        F.coalesce(F.avg(F.col("__nth") / F.col("__rank")), F.lit(0.0)).alias("ap"),
        F.coalesce(F.lit(1.0) / F.min("__rank"), F.lit(0.0)).alias("mrr"),
        F.count("__rank").alias("n_relevant"),
        F.count("*").alias("n_all"),
        F.coalesce(F.sum("__rank"), F.lit(0)).alias("__sum"),
    )
    pos, neg = F.col("n_relevant"), F.col("n_all") - F.col("n_relevant")
    # Mann-Whitney: pairs in which the relevant item stands before the other.
    before = pos * neg - (F.col("__sum") - pos * (pos + 1) / 2)
    return g.select(query, "ap", "mrr", F.when((pos > 0) & (neg > 0), before / (pos * neg)).otherwise(0.0).alias("auc"), "n_relevant")


def macro_mean(scores: DataFrame, levels: DataFrame, group: str, metrics: list[str]) -> DataFrame:
    """Means of a group's rows, then of each level's groups; a group may belong to several levels."""
    by_group = scores.groupBy(group).agg(*[F.avg(m).alias(m) for m in metrics])
    return by_group.join(levels, group).groupBy("level").agg(*[F.avg(m).alias(m) for m in metrics], F.count("*").alias("n_groups"))
