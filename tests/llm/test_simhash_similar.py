import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.llm.simhash_similar import PRUNED, bands, deduplicate_similar, differing, long_simhash, similar_documents

from .brute import TEXTS, docs, rows


def shingles(text, size=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def corpus(seed):
    """Texts of random words, near copies of them at known similarities, and a large family."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 6)))
    texts = []
    for k in range(40):
        words = [word() for _ in range(rng.randint(60, 400))]
        texts.append(" ".join(words))
        for _ in range(k % 3):
            copy = list(words)
            for _ in range(max(1, len(words) // rng.choice([60, 200]))):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    base = [word() for _ in range(300)]
    for _ in range(150):
        copy = list(base)
        copy[rng.randrange(300)] = word()
        texts.append(" ".join(copy))
    return texts


def test_bits_follow_the_similarity():
    texts = corpus(1)[:60]
    sets, fps = [shingles(t) for t in texts], [np.frombuffer(long_simhash(t.encode()), np.uint8) for t in texts]
    for i in range(60):
        for j in range(i):
            n = int(np.bitwise_count(fps[i] ^ fps[j]).sum())
            s = jaccard(sets[i], sets[j])
            if s >= 0.85 or s <= 0.6:
                assert (n <= differing(0.8)) == (s >= 0.85)
    assert long_simhash(None) == long_simhash(b" ") == bytes(128)


def test_groups(spark):
    texts = corpus(2) + TEXTS
    got = {r["doc_id"]: r["component_id"] for r in rows(similar_documents(docs(spark, texts).repartition(4)))}
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))
    sure = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.85]
    assert sum(got[i] == got[j] for i, j in sure) >= 0.99 * len(sure)
    loose = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.7]
    for i, j in loose:
        a, b = root[i], root[j]
        root = [min(a, b) if x in (a, b) else x for x in root]
    assert all(root[i] == root[c] for i, c in got.items())


def boundary(seed, pairs=40):
    """Pairs of texts, in turn at exactly 0.8 and at 395 of 505 shingles (0.78)."""
    rng, texts = random.Random(seed), []
    for k in range(pairs):
        words = [f"w{rng.randrange(10**9)}" for _ in range(454)]
        copy = list(words)
        for i in range(10 + k % 2):
            copy[10 + 40 * i] = f"v{rng.randrange(10**9)}"
        texts += [" ".join(words), " ".join(copy)]
    return texts


@pytest.mark.parametrize("together", [2000, 1, 7])
def test_links_are_exact_at_the_similarity(spark, together):
    texts = boundary(1) + corpus(3)[-60:]
    sets = [shingles(t) for t in texts]
    assert jaccard(sets[0], sets[1]) == 0.8 and 0.78 < jaccard(sets[2], sets[3]) < 0.8
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    got = {r["doc_id"]: r["component_id"] for r in rows(similar_documents(docs(spark, texts).repartition(3), together=together))}
    assert got == dict(enumerate(root))


def test_deduplicate(spark):
    df = docs(spark, TEXTS).withColumn("fp", F.lit("kept"))
    left = rows(deduplicate_similar(df))
    # 0 to 3 have no words; 6, 7 and 13 are one passage.
    assert {r["doc_id"] for r in left} == {0, 4, 5, 6, 8, 9, 10, 11, 12, 14} and all(r["fp"] == "kept" for r in left)
    assert rows(similar_documents(docs(spark, []))) == []


def test_deduplicate_by_rows(spark):
    """Repeated and null ids, and columns of any name."""
    a, b, c = corpus(4)[0], corpus(5)[0], corpus(6)[0]
    near = " ".join([*a.split(), "more"])
    given = [(1, a), (1, a), (1, b), (None, near), (None, c), (None, c), (0, "x y z w"), (2, near)]
    clash = {k: F.lit(k) for k in ("row", "fp", "n", "root", "uid", "keeper", "first", "component_id", "bucket")}
    left = rows(deduplicate_similar(docs(spark, [t for _, t in given], [i for i, _ in given]).withColumns(clash)))
    assert sorted(((r["doc_id"], r["text"]) for r in left), key=str) == sorted([(1, a), (1, b), (None, c), (0, "x y z w")], key=str)
    assert all(r[k] == k for r in left for k in clash)


def test_recall_of_candidates(spark):
    """Of 400 pairs at exactly 0.8 nearly all are linked, also with the bands of a much larger table."""
    texts = boundary(7, 400)
    pairs = [(2 * k, 2 * k + 1) for k in range(0, 400, 2)]
    got = {r["doc_id"]: r["component_id"] for r in rows(similar_documents(docs(spark, texts).repartition(4)))}
    assert sum(got[i] == got[j] for i, j in pairs) >= 0.98 * len(pairs)
    for n in (10**4, 10**7, 10**9):
        of = bands(n, 0.8)
        assert all(len(x) == len(of[0]) for x in of) and n >> len(of[0]) <= 256
        fps = [np.unpackbits(np.frombuffer(long_simhash(t.encode()), np.uint8)) for t in texts]
        met = sum(any((fps[i][x] == fps[j][x]).all() for x in of) for i, j in pairs)
        assert met >= 0.98 * len(pairs)


@pytest.mark.parametrize("similarity,n,changed", [(0.5, 450, 30), (0.6, 400, 20), (0.7, 340, 12)])
def test_recall_at_other_similarities(spark, similarity, n, changed):
    """Pairs of n shingles each at exactly the similarity: the trie is pruned by what the similarity asks for."""
    rng, texts = random.Random(changed), []
    for _ in range(150):
        words = [f"w{rng.randrange(10**9)}" for _ in range(n + 4)]
        copy = list(words)
        for i in range(changed):
            copy[10 + (n - 20) // changed * i] = f"v{rng.randrange(10**9)}"
        texts += [" ".join(words), " ".join(copy)]
    assert jaccard(shingles(texts[0]), shingles(texts[1])) == similarity
    got = {r["doc_id"]: r["component_id"] for r in rows(similar_documents(docs(spark, texts).repartition(4), similarity=similarity))}
    assert sum(got[k] == got[k + 1] for k in range(0, 300, 2)) >= 0.98 * 150


def test_pruning_follows_the_similarity():
    assert [differing(s, 64, PRUNED) for s in (0.8, 0.5)] == [20, 30]
