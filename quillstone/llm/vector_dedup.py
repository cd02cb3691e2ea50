"""Near-duplicate vectors by navigable small-world graphs, one for each shard.

Equal vectors are collapsed, the others normalised in double precision and dealt over shards; each shard becomes a
hierarchical graph whose points have few neighbours of varied direction. Every shard's vectors are searched in
every shard's graph (a pair of shards once), many queries in lockstep. From the hits of a beam the search floods
on through all neighbours near the threshold, so the beam caps no group of links. Before a pair of shards is searched, a
sample of its queries is audited against brute force: the beam is doubled until all links of `RECALL` of those that have any
are found or, where none has, the nearest vector of `NEAREST` of them. Where no beam reaches that, the pair is compared outright, in blocks.
`audits` reports beam and recall of every pair. Hits are verified by cosine in double precision and folded block by block into
link counts and a spanning forest, so that neither a task nor its result ever holds the pairs of a hot group; forests
are united by connected components.

Defined results: vectors that are null, empty or zero, or hold null or non-finite components, link with nothing; vectors of
different lengths never link; rows of one id are separate vectors; a null id is never a component's name
unless all its members have none; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table
from .components import connected_components, join_hot, merge_labels

COSINE, SHARDS, SHARD_ROWS = 0.9, 8, 100_000
DEGREE, MOST, UPPER, EF_BUILD, EF, BATCH, EXPAND = 16, 24, 12, 32, 32, 512, 4
#: Links that must lead to a point, and room for those that are added for it.
LINKED, ROOM = 4, 12
AUDITED, RECALL, NEAREST, MARGIN = 512, 0.995, 0.9, 0.05
#: Bytes of a shard's vectors in double precision, pairs that a task holds at once.
SHARD_BYTES, PAIRS = 64 << 20, 1 << 20
COUNT, AUDIT = -1, -2


def _select(x: np.ndarray, ids: np.ndarray, sims: np.ndarray, m: int) -> np.ndarray:
    """Of each row's candidates (best first, -1: none) up to m: those nearer to the point than to any chosen one, then the best of the rest."""
    rows, c = ids.shape
    v = x[np.maximum(ids, 0)]
    between = v @ v.transpose(0, 2, 1)
    valid = ids >= 0
    chosen = np.zeros((rows, c), bool)
    for j in range(c):
        chosen[:, j] = valid[:, j] & ~((between[:, j, :] > sims[:, j, None]) & chosen).any(1)
    rank = np.where(chosen, 0, np.where(valid, c, 2 * c)) + np.arange(c)
    order = np.argsort(rank, axis=1)[:, :m]
    out = np.take_along_axis(ids, order, 1)
    return np.pad(out, ((0, 0), (0, max(0, m - c))), constant_values=-1)


class Graph:
    """Points in descending order of their top level; level l holds the first sizes[l] of them."""

    def __init__(self, x: np.ndarray, degree: int = DEGREE, most: int = MOST, upper: int = UPPER, ef: int = EF_BUILD):
        n = len(x)
        levels = np.floor(-np.log(1 - np.random.default_rng(n).random(n)) / math.log(upper)).astype(int)
        self.order = np.argsort(-levels, kind="stable")
        self.x = np.ascontiguousarray(x[self.order], np.float32)
        levels = levels[self.order]
        self.sizes = [int((levels >= k).sum()) for k in range(levels.max() + 1)] if n else [0]
        self.upper = [self._nearest(s, min(upper, max(s - 1, 1))) for s in self.sizes[1:]]
        first = min(n, max(self.sizes[1] if len(self.sizes) > 1 else 1, 256))
        self.near = np.full((n, most + ROOM), -1, np.int32)
        self.used = np.zeros(n, np.int64)
        if n:
            head = self._nearest(first, min(degree, max(first - 1, 1)))
            self.near[:first, : head.shape[1]] = head
            self.used[:first] = (head >= 0).sum(1)
        s = first
        while s < n:
            e = min(n, s + min(BATCH, s))
            self._insert(s, e, degree, most, ef)
            s = e
        self._reach(most + ROOM)
        self._join_islands(most + ROOM)

    def _flood(self, start: np.ndarray, known: np.ndarray) -> None:
        """Marks in known all points to which links lead from start."""
        known[start] = True
        while len(start):
            new = np.unique(self.near[start])
            start = new[(new >= 0) & ~known[new]]
            known[start] = True

    def _join_islands(self, width: int) -> None:
        """Groups of near-equal points may only link among themselves: the nearest point outside gets a link to each."""
        known = np.zeros(len(self.x), bool)
        if len(self.x):
            self._flood(np.array([0]), known)
        reached, heads = known.copy(), []
        for v in np.flatnonzero(~known).tolist():
            if not known[v]:
                heads.append(v)
                self._flood(np.array([v]), known)
        for s in range(0, len(heads), BATCH):
            part = heads[s : s + BATCH]
            ids, _ = self.beam(self.x[part], 4 * BATCH)
            for v, row in zip(part, ids.tolist(), strict=True):
                left = 2
                for u in row:
                    if left and u >= 0 and reached[u] and self.used[u] < width:
                        self.near[u, self.used[u]] = v
                        self.used[u] += 1
                        left -= 1

    def _reach(self, width: int) -> None:
        """Points to which few links lead get links from their own nearest neighbours."""
        links = np.bincount(self.near[self.near >= 0], minlength=len(self.x))
        for v in np.flatnonzero(links < LINKED).tolist():
            missing = LINKED - links[v]
            for u in self.near[v, : self.used[v]].tolist():
                if missing and self.used[u] < width and v not in self.near[u]:
                    self.near[u, self.used[u]] = v
                    self.used[u] += 1
                    missing -= 1

    def _nearest(self, size: int, m: int) -> np.ndarray:
        """Neighbours of the first points among themselves, by brute force (upper levels and the first points)."""
        out, c = np.full((size, m), -1, np.int32), min(3 * m, size - 1)
        for s in range(0, size if c > 0 else 0, 512):
            sims = self.x[s : min(s + 512, size)] @ self.x[:size].T
            sims[np.arange(len(sims)), np.arange(s, s + len(sims))] = -np.inf
            ids = np.argpartition(-sims, c - 1, axis=1)[:, :c]
            best = np.take_along_axis(sims, ids, 1)
            order = np.argsort(-best, axis=1)
            out[s : s + len(sims)] = _select(self.x, np.take_along_axis(ids, order, 1), np.take_along_axis(best, order, 1), m)
        return out

    def _insert(self, s: int, e: int, degree: int, most: int, ef: int) -> None:
        q = self.x[s:e]
        ids, sims = self.beam(q, ef, s)
        among = q @ q.T
        among[np.arange(e - s), np.arange(e - s)] = -np.inf
        k = min(8, e - s - 1)
        if k:
            own = np.argpartition(-among, k - 1, axis=1)[:, :k]
            ids, sims = np.concatenate([ids, own + s], 1), np.concatenate([sims, np.take_along_axis(among, own, 1)], 1)
        order = np.argsort(-sims, axis=1)
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        chosen = _select(self.x, ids, sims, degree)
        self.near[s:e, :degree] = chosen
        self.used[s:e] = (chosen >= 0).sum(1)
        src, at = np.nonzero(chosen >= 0)
        dst, src = chosen[src, at].astype(np.int64), src + s
        new = ~(self.near[dst] == src[:, None]).any(1)
        dst, src = dst[new], src[new]
        # Back links: appended where there is room; where there is none, the point's neighbours are chosen anew.
        sim = np.einsum("ij,ij->i", self.x[dst], self.x[src])
        order = np.lexsort((-sim, dst))
        dst, src, sim = dst[order], src[order], sim[order]
        start = np.flatnonzero(np.concatenate([[True], dst[1:] != dst[:-1]]))
        rank = np.arange(len(dst)) - np.repeat(start, np.diff(np.concatenate([start, [len(dst)]])))
        room = self.used[dst] + rank
        fits = room < most
        self.near[dst[fits], room[fits]] = src[fits]
        full = np.unique(dst[~fits])
        np.add.at(self.used, dst[fits], 1)
        if len(full):
            extra = np.full((len(full), most), -1, np.int64)
            rest = ~fits
            row = np.searchsorted(full, dst[rest])
            first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            k = np.arange(len(row)) - np.repeat(first, np.diff(np.concatenate([first, [len(row)]])))
            few = k < most
            extra[row[few], k[few]] = src[rest][few]
            ids = np.concatenate([self.near[full].astype(np.int64), extra], 1)
            sims = np.where(ids >= 0, np.einsum("ij,ikj->ik", self.x[full], self.x[np.maximum(ids, 0)]), -np.inf)
            order = np.argsort(-sims, axis=1)[:, : 2 * degree]
            chosen = _select(self.x, np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1), degree)
            self.near[full] = -1
            self.near[full, :degree] = chosen
            self.used[full] = (chosen >= 0).sum(1)

    def beam(self, q: np.ndarray, ef: int, live: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of up to ef near points of each query, best first; only the first `live` points are in."""
        n = len(self.x) if live is None else live
        rows = np.arange(len(q))
        now = np.zeros(len(q), np.int64)
        best = q @ self.x[0]
        for near in reversed(self.upper):
            moved = rows
            while len(moved):
                ids = near[now[moved]]
                sims = np.where(ids >= 0, np.einsum("ij,ikj->ik", q[moved], self.x[np.maximum(ids, 0)]), -np.inf)
                k = sims.argmax(1)
                top = sims[np.arange(len(moved)), k]
                up = top > best[moved]
                moved, k, top, ids = moved[up], k[up], top[up], ids[up]
                now[moved], best[moved] = ids[np.arange(len(moved)), k], top
        ef = min(ef, n)
        ids, sims, done = np.full((len(q), ef), -1, np.int64), np.full((len(q), ef), -np.inf, np.float32), np.zeros((len(q), ef), bool)
        ids[:, 0], sims[:, 0] = now, best
        seen = np.zeros((len(q), n), bool)
        seen[rows, now] = True
        active = rows
        while len(active):
            waiting = np.where(done[active], -np.inf, sims[active])
            pick = np.argpartition(-waiting, min(EXPAND, ef) - 1, axis=1)[:, : min(EXPAND, ef)] if ef > EXPAND else np.tile(np.arange(ef), (len(active), 1))
            ok = np.take_along_axis(waiting, pick, 1) > -np.inf
            go = ok.any(1)
            active, pick, ok = active[go], pick[go], ok[go]
            if not len(active):
                break
            found = []
            for j in range(pick.shape[1]):
                new = np.where(ok[:, j, None], self.near[np.maximum(ids[active, pick[:, j]], 0)], -1)
                new = np.where(new < n, new, -1)
                fresh = (new >= 0) & ~seen[active[:, None], np.maximum(new, 0)]
                new = np.where(fresh, new, -1)
                r, c = np.nonzero(fresh)
                seen[active[r], new[r, c]] = True
                done[active[ok[:, j]], pick[ok[:, j], j]] = True
                found.append(new)
            new = np.concatenate(found, 1)
            r, c = np.nonzero(new >= 0)
            score = np.full(new.shape, -np.inf, np.float32)
            score[r, c] = np.einsum("ij,ij->i", q[active[r]], self.x[new[r, c]])
            ids_, sims_, done_ = np.concatenate([ids[active], new], 1), np.concatenate([sims[active], score], 1), np.concatenate([done[active], np.zeros(new.shape, bool)], 1)
            top = np.argpartition(-sims_, ef - 1, axis=1)[:, :ef]
            ids[active], sims[active], done[active] = (np.take_along_axis(v, top, 1) for v in (ids_, sims_, done_))
        order = np.argsort(-sims, axis=1)
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def within(self, q: np.ndarray, least: float, ef: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, point) of the points found with a similarity of some `least` or more, each pair once, in blocks."""
        near = least - MARGIN
        out_q, out_p, size = [], [], 0
        # The flood also goes against the direction of links.
        src, at = np.nonzero(self.near >= 0)
        dst = self.near[src, at]
        order = np.argsort(dst, kind="stable")
        into, first = src[order], np.searchsorted(dst[order], np.arange(len(self.x) + 1)).tolist()
        step = max(16, min(1024, 64_000_000 // max(1, len(self.x))))
        for s in range(0, len(q), step):
            ids, sims = self.beam(q[s : s + step], ef)
            for r in np.flatnonzero((sims >= near).any(1)):
                v = q[s + r]
                front = ids[r][sims[r] >= near]
                known = np.zeros(len(self.x), bool)
                known[front] = True
                hits = [front]
                while len(front):
                    new = np.unique(np.concatenate([self.near[front].ravel(), *(into[first[k] : first[k + 1]] for k in front.tolist())]))
                    new = new[(new >= 0) & ~known[new]]
                    known[new] = True
                    front = new[self.x[new] @ v >= near]
                    hits.append(front)
                hits = np.concatenate(hits).astype(np.int64)
                out_q.append(np.full(len(hits), s + r))
                out_p.append(hits)
                size += len(hits)
                if size >= PAIRS:
                    yield np.concatenate(out_q), np.concatenate(out_p)
                    out_q, out_p, size = [], [], 0
        if out_q:
            yield np.concatenate(out_q), np.concatenate(out_p)


def audited_beam(graph: Graph, exact: np.ndarray, q: np.ndarray, least: float, own: bool, recall: float = RECALL, nearest: float = NEAREST) -> tuple[int | None, float]:
    """The beam that finds enough of what a sample of the queries must find, and the share that it finds; no beam where none does.

    exact has the graph's points and q the queries (its own points, if `own`), in double precision.
    """
    sample = np.unique(np.linspace(0, len(q) - 1, min(AUDITED, len(q))).astype(int)) if len(q) else np.zeros(0, int)
    n, links, best = len(exact), [], []
    for s in range(0, len(sample), 64):
        sims = q[sample[s : s + 64]] @ exact.T
        if own:
            sims[np.arange(len(sims)), sample[s : s + 64]] = -np.inf
        r, p = np.nonzero(sims >= least)
        links.append((r + s) * n + p)
        best.append(sims.argmax(1))
    if n < 2 or not len(sample):
        return EF, 1.0
    links, best = np.concatenate(links), np.concatenate(best)
    asked, ef = q[sample].astype(np.float32), EF
    while ef < n:
        if len(links):
            missed = links
            for a, b in graph.within(asked, least, ef):
                missed = missed[~np.isin(missed, a * n + b)]
            found = 1 - len(np.unique(missed // n)) / len(np.unique(links // n))
        else:
            ids, _ = graph.beam(asked, ef)
            found = float((ids == best[:, None]).any(1).mean())
        if found >= (recall if len(links) else nearest):
            return ef, found
        ef *= 2
    return None, 1.0


def search(graph: Graph, exact: np.ndarray, q: np.ndarray, least: float, ef: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Verified (query, point) pairs in blocks; without a beam by comparing all."""
    if ef is None:
        step = max(1, PAIRS // max(1, len(exact)))
        for s in range(0, len(q), step):
            a, b = np.nonzero(q[s : s + step] @ exact.T >= least)
            yield a + s, b
        return
    for a, b in graph.within(q.astype(np.float32), least, ef):
        good = np.concatenate([np.einsum("ij,ij->i", q[a[s : s + 100_000]], exact[b[s : s + 100_000]]) >= least for s in range(0, len(a), 100_000)])
        yield a[good], b[good]


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("uid")
    x = np.array(rows["vector"].tolist(), np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = Graph(x)
    parts = {"graph": graph.__dict__, "x": x[graph.order], "uid": rows["uid"].to_numpy()[graph.order], "n": rows["n"].to_numpy()[graph.order]}
    return pd.DataFrame({"dim": [int(rows["dim"].iloc[0])], "shard": [int(rows["shard"].iloc[0])], "graph": [pickle.dumps(parts, protocol=5)]})


def _compare(least: float) -> Callable:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """One pair of shards (a shard with itself has one row): link counts, and edges of a spanning forest."""
        parts = [pickle.loads(x) for x in rows.sort_values("shard")["graph"]]
        left, right = parts[0], parts[-1]
        graph = Graph.__new__(Graph)
        graph.__dict__.update(right["graph"])
        own, size = len(parts) == 1, len(left["uid"])
        uid, base = (left["uid"], 0) if own else (np.concatenate([left["uid"], right["uid"]]), size)
        count, labels = np.zeros(len(uid)), np.arange(len(uid))
        ef, recall = audited_beam(graph, right["x"], left["x"], least, own)
        for a, b in search(graph, right["x"], left["x"], least, ef):
            if own:
                a, b = a[a != b], b[a != b]
            count += np.bincount(a, right["n"][b], len(uid))
            if not own:
                count += np.bincount(b + base, left["n"][a], len(uid))
            labels = merge_labels(labels, a, b + base)
        some, joined = np.flatnonzero(count), np.flatnonzero(labels != np.arange(len(uid)))
        shards = rows["shard"].tolist()
        out = [(uid[some], np.full(len(some), COUNT), count[some]), (uid[joined], uid[labels[joined]], np.zeros(len(joined))), ([min(shards)], [AUDIT], [max(shards)])]
        u, v, links = (np.concatenate(x).astype(np.int64) for x in zip(*out, strict=True))
        last = np.arange(len(u)) == len(u) - 1
        return pd.DataFrame({"u": u, "v": v, "links": links, "beam": pd.Series(np.where(last, ef or 0, 0), dtype="int32"), "recall": np.where(last, recall, np.nan)})

    return run


def _distinct(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with their vector (null if it links with nothing), and the different vectors."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    whole = F.forall("vector", lambda v: F.coalesce(F.abs(v) < F.lit(math.inf), F.lit(False)))
    good = F.coalesce(whole & F.exists("vector", lambda v: v != 0), F.lit(False))
    rows = rows.withColumn("vector", F.when(good, F.col("vector")))
    distinct = rows.filter("vector is not null").groupBy("vector").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
    return rows, staged(distinct.withColumn("uid", F.monotonically_increasing_id()), "distinct")


def _searched(distinct: DataFrame, least: float, shards: int, shard_rows: int) -> DataFrame:
    """Of every pair of shards: link counts (v is COUNT), edges of a forest (u, v), and its audit (v is AUDIT; u and links are the shards)."""
    total = distinct.agg(F.count("*").alias("n"), F.coalesce(F.sum(8 * F.size("vector").cast("long")), F.lit(0)).alias("bytes")).first()
    shards = max(shards, -(-total["n"] // shard_rows), -(-total["bytes"] // SHARD_BYTES))
    dealt = distinct.select("uid", "n", "vector", F.size("vector").alias("dim"), F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("int").alias("shard"))
    graphs = staged(dealt.groupBy("dim", "shard").applyInPandas(_build, "dim int, shard int, graph binary"), "graphs")
    names = graphs.select("dim", "shard")
    pairs = names.withColumnRenamed("shard", "i").join(names.withColumnRenamed("shard", "j"), "dim").filter("i <= j")
    sides = pairs.select("dim", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("shard"))
    met = graphs.join(sides, ["dim", "shard"]).groupBy("dim", "i", "j").applyInPandas(_compare(least), "u long, v long, links long, beam int, recall double")
    return staged(met, "links")


def audits(vectors: DataFrame, least: float = COSINE, shards: int = SHARDS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """i, j, beam (0: compared outright), recall of the audited queries of every pair of shards."""
    met = _searched(_distinct(vectors)[1], least, shards, shard_rows)
    return met.filter(F.col("v") == AUDIT).select(F.col("u").cast("int").alias("i"), F.col("links").cast("int").alias("j"), "beam", "recall")


def link_vectors(vectors: DataFrame, least: float = COSINE, shards: int = SHARDS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """vec_id, n_links, component_id of every row of vectors (vec_id, embedding)."""
    rows, distinct = _distinct(vectors)
    met = _searched(distinct, least, shards, shard_rows)
    roots = connected_components(met.filter("v >= 0").select("u", "v")).select(F.col("node").alias("uid"), "root")
    links = met.filter(F.col("v") == COUNT).groupBy(F.col("u").alias("uid")).agg(F.sum("links").alias("links"))
    known = distinct.join(links, "uid", "left").join(roots, "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    known = staged(known.select("vector", "first", "n", F.coalesce("links", F.lit(0)).alias("links"), "root"), "known")
    named = known.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("members"))
    some = join_hot(known.filter("n > 1 or links > 0"), named, "root", known.count(), "members")
    named = some.select("vector", "n", (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id")
    out = join_hot(rows, named, "vector", vectors.count())
    alone = F.col("n").isNull()
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.when(alone, F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))


def op7_vectors_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = link_vectors(table(spark, sf_dir, "embeddings"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


QUERIES = {"op7_vectors_hnsw": op7_vectors_hnsw}
ORACLES: dict[str, str] = {
    "op7_vectors_hnsw": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.9),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, least(a, min(b)) AS component FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component, vec_id) AS component_id, vec_id = coalesce(component, vec_id) AS kept FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id"""
}
