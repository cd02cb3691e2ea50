import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from quillstone.llm.quality import FEATURES, Gam, classify, features_of, keep_good, op6_quality_gam

from .brute import TEXTS, docs, rows


def auc(score, label):
    rank = np.argsort(np.argsort(score)) + 1
    pos, neg = (label == 1).sum(), (label == 0).sum()
    return (rank[label == 1].sum() - pos * (pos + 1) / 2) / (pos * neg)


def test_model_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = Gam(x[:2000], y[:2000])
    assert m.pairs[0][:2] == (1, 0)
    assert auc(m.score(x[2000:]), y[2000:]) > 0.95


def plain_leaves(g, h):
    """One cut after another, each by trying all."""
    value = lambda a, b: sum(g[a:b]) ** 2 / (sum(h[a:b]) + 1)
    edges = [0, len(g)]
    for _ in range(2):
        gain, cut = max([(value(a, m) + value(m, b) - value(a, b), -m) for a, b in zip(edges, edges[1:]) for m in range(a + 1, b)], default=(0, 0))
        if gain <= 1e-9:
            break
        edges = sorted([*edges, -cut])
    return [sum(g[a:b]) / (sum(h[a:b]) + 1) for a, b in zip(edges, edges[1:]) for _ in range(a, b)]


def plain_crossed(g, h):
    """The best cut on each of two features, by trying all."""
    best = (0, None)
    for i in range(1, len(g)):
        for j in range(1, len(g[0])):
            boxes = [(a, b, c, d) for a, b in ((0, i), (i, len(g))) for c, d in ((0, j), (j, len(g[0])))]
            sums = [(sum(map(sum, (r[c:d] for r in g[a:b]))), sum(map(sum, (r[c:d] for r in h[a:b])))) for a, b, c, d in boxes]
            gain = sum(x * x / (y + 1) for x, y in sums)
            if best[1] is None or gain > best[0]:
                best = (gain, list(zip(boxes, sums)))
    out = [[0.0] * len(g[0]) for _ in g]
    for (a, b, c, d), (x, y) in best[1]:
        for i in range(a, b):
            for j in range(c, d):
                out[i][j] = x / (y + 1)
    whole = sum(map(sum, g)) ** 2 / (sum(map(sum, h)) + 1)
    return best[0] - whole, out


def plain_gam(x, y, model, cycles, pair_cycles, pairs, rate):
    """Tables and scores row by row, over the model's own bins."""
    at = [[sum(c <= v for c in cuts) for cuts, v in zip(model.cuts, r)] for r in x]
    coarse = [[sum(c <= v for c in cuts) for cuts, v in zip(model.coarse, r)] for r in x]
    f, tables = [model.base] * len(x), [[0.0] * (len(c) + 1) for c in model.cuts]
    p = lambda v: 1 / (1 + math.exp(-v))

    def grids(a, b):
        g, h = ([[0.0] * (len(model.coarse[b]) + 1) for _ in range(len(model.coarse[a]) + 1)] for _ in range(2))
        for i, r in enumerate(coarse):
            g[r[a]][r[b]] += y[i] - p(f[i])
            h[r[a]][r[b]] += p(f[i]) * (1 - p(f[i]))
        return g, h

    for _ in range(cycles):
        for j, t in enumerate(tables):
            g, h = [0.0] * len(t), [0.0] * len(t)
            for i, r in enumerate(at):
                g[r[j]] += y[i] - p(f[i])
                h[r[j]] += p(f[i]) * (1 - p(f[i]))
            step = [rate * v for v in plain_leaves(g, h)]
            tables[j] = [v + w for v, w in zip(t, step)]
            f = [v + step[r[j]] for v, r in zip(f, at)]
    best = sorted(((plain_crossed(*grids(a, b))[0], a, b) for a in range(len(x[0])) for b in range(a)), reverse=True)[:pairs]
    crossed = {(a, b): None for _, a, b in best}
    for _ in range(pair_cycles):
        for a, b in crossed:
            step = [[rate * v for v in r] for r in plain_crossed(*grids(a, b))[1]]
            crossed[a, b] = step if crossed[a, b] is None else [[v + w for v, w in zip(q, r)] for q, r in zip(crossed[a, b], step)]
            f = [v + step[r[a]][r[b]] for v, r in zip(f, coarse)]
    return tables, crossed, [p(v) for v in f]


def test_model_against_plain_loops():
    rng = np.random.default_rng(3)
    x = rng.random((300, 4)).round(2)
    y = ((x[:, 0] + 0.3 * rng.random(300) > 0.6) ^ (x[:, 2] > 0.7)).astype(float)
    m = Gam(x, y, cycles=4, pair_cycles=3, pairs=2, rate=0.2)
    tables, crossed, scores = plain_gam(x.tolist(), y.tolist(), m, 4, 3, 2, 0.2)
    assert all(np.allclose(a, b) for a, b in zip(m.tables, tables, strict=True))
    assert [p[:2] for p in m.pairs] == list(crossed)
    assert all(np.allclose(t, crossed[a, b]) for a, b, t in m.pairs)
    assert np.allclose(m.score(x), scores)


def test_rows_of_one_id(spark):
    """A bad row does not take the good rows of its id, and equal rows share their fate."""
    texts, labels = sets(spark)
    good, bad = texts[1], texts[0]
    df = docs(spark, [*texts[:200], good, bad, bad, bad, good], [*range(200), 500, 500, 500, None, None])
    left = [(r["doc_id"], r["text"]) for r in rows(keep_good(df, labels)) if r["doc_id"] is None or r["doc_id"] >= 200]
    assert sorted(left, key=str) == sorted([(500, good), (None, good)], key=str)


def test_features():
    assert features_of(None) == features_of(b"") == features_of(b" \n") == [0.0] * len(FEATURES)
    v = dict(zip(FEATURES, features_of("SHOUT!! SHOUT!! b é|".encode())))
    assert (v["bang_share"], v["next_same_share"], v["distinct_share"], v["upper_word_share"]) == (1.0, 0.25, 0.75, 0.5)
    assert all(len(features_of((t or "").encode())) == len(FEATURES) for t in TEXTS)


def sets(spark):
    texts = [("plain words here and there " * (1 + k % 5)) if k % 2 else "NOISE!! $$$ | " * (1 + k % 7) for k in range(200)] + TEXTS
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(200)] + [(3, 1, 0), (None, 1, 0), (7, None, 0), (999, 0, 1)], "doc_id long, quality int, toxic int")
    return texts, labels


def test_awkward_rows(spark):
    texts, labels = sets(spark)
    df = docs(spark, texts).withColumn("score", F.lit("clash")).withColumn("quality", F.lit(5)).withColumns({c: F.lit(c) for c in ("row", "features", "a.b")}).repartition(3)
    got = rows(classify(df, labels))
    assert len(got) == len(texts)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
        if r["doc_id"] < 200:
            assert r["predicted"] == r["doc_id"] % 2
    left = rows(keep_good(df, labels))
    assert {r["doc_id"] for r in left} == {r["doc_id"] for r in got if r["predicted"]} and left[0]["score"] == "clash"


def test_bounded_sample_and_empty_tables(spark):
    texts, labels = sets(spark)
    assert len(rows(classify(docs(spark, texts, [None] * 3 + list(range(3, len(texts)))), labels, sample=60))) == len(texts)
    assert {r["score"] for r in rows(classify(docs(spark), labels.limit(0)))} == {0.5}
    assert {r["score"] for r in rows(classify(docs(spark, texts), labels.filter("quality = 1")))} == {1.0}
    assert rows(classify(docs(spark, []), labels)) == []


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in rows(op6_quality_gam(spark, sf))}
    known = [(got[r.doc_id], r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    held = [(g["score"], q) for g, q in known if g["held_out"]]
    score, label = (np.array(x) for x in zip(*held))
    assert auc(score, label) > 0.97 and ((score >= 0.3) == label).mean() > 0.95
