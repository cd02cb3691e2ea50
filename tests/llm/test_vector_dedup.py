import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.llm.vector_dedup import RECALL, Graph, audited_beam, audits, link_vectors, op7_vectors_hnsw, search

from .brute import rows

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(pairs, least=0.9):
    """[(id, vector)] to {id: (links, component)}; ids unique."""
    good = [(i, np.array(v, float)) for i, v in pairs if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    near = {i: set() for i, _ in pairs}
    for i, a in good:
        for j, b in good:
            if i != j and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= least:
                near[i].add(j)
    out = {}
    for i in near:
        seen, todo = {i}, [i]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        out[i] = (len(near[i]), min(seen))
    return out


def clusters(seed, n, dim=16):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 8, dim))
    out = [base[rng.integers(len(base))] + 0.08 * rng.normal(size=dim) for _ in range(n)]
    return [[float(np.float32(x)) for x in v] for v in out]


@pytest.mark.parametrize("n", [1, 2, 3, 40, 700, 3000])
def test_graph_finds_what_brute_force_finds(n):
    x = np.random.default_rng(n).normal(size=(n, 12))
    x[n // 2 :] = x[: n - n // 2] + 0.05 * np.random.default_rng(1).normal(size=(n - n // 2, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = Graph(x)
    assert sorted(g.order.tolist()) == list(range(n))
    ef, found = audited_beam(g, x[g.order], x[g.order], 0.9, True)
    assert found >= 0.9
    got = {(i, j) for a, b in search(g, x[g.order], x, 0.9, ef) for i, j in zip(a.tolist(), g.order[b].tolist())}
    want = set(zip(*(v.tolist() for v in np.nonzero(x @ x.T >= 0.9))))
    assert got <= want | {(i, i) for i in range(n)} and len(got) >= 0.97 * len(want)


def test_awkward_rows(spark):
    inf = float("inf")
    vs = clusters(1, 60) + [None, [], [0.0] * 16, [None] * 16, [float("nan")] + [1.0] * 15, [inf] * 16, [1.0] * 5, [2.0] * 5, [1e30] * 16, [1e30] * 16]
    vs += [[2 * x for x in vs[0]], vs[0], vs[0]]
    pairs = list(enumerate(vs))
    df = spark.createDataFrame([(i, v, 0) for i, v in pairs], SCHEMA).withColumn("n", F.lit("clash")).withColumn("vector", F.lit(1)).repartition(4)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in rows(link_vectors(df, shards=3))}
    assert got == plain(pairs)


def test_null_ids_and_empty(spark):
    v = [1.0, 0.5]
    got = rows(link_vectors(spark.createDataFrame([(None, v, 0), (4, v, 0), (4, v, 0), (None, [-1.0, 3.0], 0)], SCHEMA)))
    assert sorted(str((r["vec_id"], r["n_links"], r["component_id"])) for r in got) == ["(4, 2, 4)", "(4, 2, 4)", "(None, 0, None)", "(None, 2, 4)"]
    assert rows(link_vectors(spark.createDataFrame([], SCHEMA))) == []


def test_large_group_and_recall(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=16)
    vs = clusters(2, 400) + [(base + 0.05 * rng.normal(size=16)).tolist() for _ in range(400)]
    pairs = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(vs)]
    want = plain(pairs)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in rows(link_vectors(spark.createDataFrame([(i, v, 0) for i, v in pairs], SCHEMA), shards=4))}
    assert sum(n for n, _ in got.values()) >= 0.98 * sum(n for n, _ in want.values())
    assert all(got[i][0] <= want[i][0] for i in want)
    # One missed link near the threshold can part a whole cluster here.
    assert sum(got[i][1] == want[i][1] for i in want) >= 0.95 * len(want)


def test_pairs_come_in_blocks(monkeypatch):
    """A group of mutual links is never held whole, and no pair comes twice."""
    monkeypatch.setattr("quillstone.llm.vector_dedup.PAIRS", 500)
    x = 1 + 0.01 * np.random.default_rng(1).normal(size=(300, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = Graph(x)
    for ef in (32, None):
        blocks = list(search(g, x[g.order], x[g.order], 0.9, ef))
        assert max(len(a) for a, _ in blocks) < 500 + 300 and len(blocks) > 50
        pairs = [p for a, b in blocks for p in zip(a.tolist(), b.tolist())]
        assert len(pairs) == len(set(pairs)) == 300 * 300


def test_audits_are_enforced(spark, monkeypatch):
    """A graph without links finds nothing, so every pair of shards is compared outright."""
    pairs = list(enumerate(clusters(3, 400)))
    df = spark.createDataFrame([(i, v, 0) for i, v in pairs], SCHEMA)
    got = rows(audits(df, shards=3))
    assert sorted((r["i"], r["j"]) for r in got) == [(i, j) for i in range(3) for j in range(i, 3)]
    assert all(r["recall"] >= RECALL for r in got)

    def broken(self, q, ef, live=None):
        return np.full((len(q), 1), -1), np.full((len(q), 1), -np.inf, np.float32)

    x = np.array([v for _, v in pairs])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = Graph(x)
    monkeypatch.setattr(Graph, "beam", broken)
    assert audited_beam(g, x[g.order], x[g.order], 0.9, True) == (None, 1.0)
    assert audited_beam(g, x[g.order], x[g.order], 0.9999999, True) == (None, 1.0)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    pairs = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in rows(op7_vectors_hnsw(spark, sf))}
    assert got == plain(pairs)
