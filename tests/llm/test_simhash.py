import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillstone.llm.simhash import connected_components, deduplicate, link_fingerprints, near_duplicates, op9_simhash_trie, simhash, trie_join

from .brute import PASSAGE, TEXTS, docs, rows


def plain(text, size=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    size = min(size, len(words))
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), 42) for i in range(len(words) - size + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, fps, budget=4):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= budget:
                root[find(i)] = find(j)
    best = {}
    for i in range(len(fps)):
        best.setdefault(find(i), []).append(ids[i])
    return [min(x for x in best[find(i)]) for i in range(len(fps))]


def family(seed, n, flips):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64)
    out = []
    for k in range(n):
        x = int(base[k % len(base)])
        for b in rng.integers(0, 64, flips):
            x ^= 1 << int(b)
        out.append(x)
    return out


def test_fingerprint():
    for t in [*TEXTS, "a", "a b c", "One two  three\tfour five", "é É"]:
        assert simhash(t.encode() if t is not None else None) % 2**64 == plain(t)


def test_trie_join_is_exact():
    for seed in range(6):
        keys = np.array(sorted(set(family(seed, 400, seed))), np.uint64)
        got = trie_join(keys, np.zeros(len(keys), np.int64))
        assert [int(keys[x]) for x in got] == components([int(k) for k in keys], [int(k) for k in keys])


def test_buckets_lose_no_link(spark):
    fps = sorted(set(family(3, 900, 3) + [0, 1, 2**64 - 1, 2**63]))
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = dict(zip(signed, components(signed, fps)))
    for hot in (100_000, 3):
        got = {r["node"]: r["root"] for r in rows(connected_components(link_fingerprints(df, hot=hot)))}
        assert {x: got.get(x, x) for x in signed} == want


def test_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(900, 901)], "u long, v long")
    got = {r["node"]: r["root"] for r in rows(connected_components(edges))}
    assert got == {**{k: 0 for k in range(301)}, 900: 900, 901: 900}


def near_texts():
    words = (PASSAGE + " ").split() * 12
    return [*TEXTS, *(" ".join([*words[:k], "changed", *words[k + 1 :]]) for k in range(0, 60, 7))]


def test_awkward_rows(spark):
    texts = near_texts()
    ids = [100 + k for k in range(len(texts))]
    got = rows(near_duplicates(docs(spark, texts, ids).withColumn("n", F.lit(1)).repartition(3)), "doc_id")
    fps = [plain(t) for t in texts]
    assert [r["fp"] % 2**64 for r in got] == fps
    assert [r["component_id"] for r in got] == components(ids, fps)
    assert rows(near_duplicates(docs(spark, []))) == []
    both = rows(near_duplicates(docs(spark, ["a b", "a b", "c d e f g"], [None, 4, None])))
    assert sorted(str((r["doc_id"], r["component_id"])) for r in both) == ["(4, 4)", "(None, 4)", "(None, None)"]


def test_deduplicate(spark):
    texts = near_texts()
    df = docs(spark, texts).withColumn("root", F.lit("kept"))
    left = rows(deduplicate(df))
    want = {i for i, c in enumerate(components(list(range(len(texts))), [plain(t) for t in texts])) if i == c}
    assert {r["doc_id"] for r in left} == want and all(r["root"] == "kept" for r in left)


def test_deduplicate_by_rows(spark):
    """Repeated and null ids, and columns of any name."""
    rows_ = [(1, PASSAGE), (1, PASSAGE), (1, "other words that stand alone here"), (None, PASSAGE), (None, "only without id a b c"), (None, "only without id a b c"), (0, "x y z w")]
    clash = {c: F.lit(c) for c in ("row", "fp", "n", "root", "uid", "keeper", "component_id")}
    left = rows(deduplicate(docs(spark, [t for _, t in rows_], [i for i, _ in rows_]).withColumns(clash)))
    want = [(1, PASSAGE), (1, rows_[2][1]), (None, rows_[4][1]), (0, "x y z w")]
    assert sorted(((r["doc_id"], r["text"]) for r in left), key=str) == sorted(want, key=str)
    assert all(r[c] == c for r in left for c in clash)


@pytest.mark.parametrize("small", [0, 1 << 40])
def test_hub(spark, monkeypatch, small):
    """A star of one node with all others, joined by broadcast where it lies and plainly."""
    monkeypatch.setattr("quillstone.llm.components.SMALL", small)
    edges = spark.range(1, 5000).select(F.col("id").alias("u"), F.lit(0).cast("long").alias("v")).union(spark.createDataFrame([(7000, 6000)], "u long, v long"))
    got = {r["node"]: r["root"] for r in rows(connected_components(edges))}
    assert got == {**{k: 0 for k in range(5000)}, 6000: 6000, 7000: 6000}


def test_many_equal_keys_under_a_condition(monkeypatch):
    """Leaves of one key are compared in bounded steps, and pairs that are refused stay apart."""
    monkeypatch.setattr("quillstone.llm.simhash.PAIRS", 50)
    keys, bucket = np.sort(np.array([5] * 60 + [9] * 40, np.uint64)), np.zeros(100, np.int64)
    kind = np.arange(100) % 3
    got = trie_join(keys, bucket, 0, lambda u, v: kind[u] == kind[v])
    assert got.tolist() == [next(j for j in range(100) if keys[j] == keys[i] and kind[j] == kind[i]) for i in range(100)]
    assert trie_join(keys, bucket, 0).tolist() == [0] * 60 + [60] * 40


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = sorted(texts)
    fps = [plain(texts[i]) for i in ids]
    got = rows(op9_simhash_trie(spark, sf))
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{f:016x}", c) for i, f, c in zip(ids, fps, components(ids, fps))}
