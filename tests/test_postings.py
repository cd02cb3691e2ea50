"""The fielded index against plain loops over small texts."""

import math
import re

import pytest
from pyspark.sql import functions as F

from quillstone.functions.text import stem, stemmed
from quillstone.operators import postings

TEXTS = [
    (0, "The kinase binds ATP; kinases are binding it", "Kinase family"),
    (1, "ATP binding proteins and the cat", "Other"),
    (2, "a cat sat on the mat, the mat sat", None),
    (3, None, "kinase"),
    (4, "", ""),
    (5, "binding ATP binding ATP the the", "families of cats"),
    (6, "the " * 500 + "zebra", "x"),
]


def plain_stem(w):
    if re.search("[^ae]ies$", w) and len(w) > 4:
        w = w[:-3] + "y"
    elif re.search("(ss|x|ch|sh)es$", w):
        w = w[:-2]
    elif re.search("[^su]s$", w) and len(w) > 3:
        w = w[:-1]
    m = re.fullmatch("([a-z]{3,})(ing|ed)", w)
    return m[1] if m and re.search("[aeiouy]", m[1]) else w


def words(t):
    return [plain_stem(w) for w in re.findall("[a-z0-9_-]+", (t or "").lower())]


def plain(keywords, weights, k1=1.5, b=0.75):
    docs = [(i, {"body": words(x), "name": words(y)}) for i, x, y in TEXTS]
    mean = {f: sum(len(d[f]) for _, d in docs) / len(docs) for f in weights}
    clauses = [[w for w in map(words, kw.split("|")) if w] for kw in keywords]
    clauses = [c for c in clauses if c]

    def idf(term):
        df = sum(any(term in d[f] for f in weights) for _, d in docs)
        return math.log(1 + (len(docs) - df + 0.5) / (df + 0.5))

    out = []
    for i, d in docs:
        score, had = 0.0, 0
        for clause in clauses:
            got = False
            for alt in clause:
                t = 0.0
                for f, w in weights.items():
                    tf = sum(d[f][p : p + len(alt)] == alt for p in range(len(d[f])))
                    if tf:
                        t += w * tf / (1 - b + b * len(d[f]) / mean[f])
                if t:
                    got, score = True, score + sum(map(idf, alt)) * t * (k1 + 1) / (t + k1)
            had += got
        if clauses and had == len(clauses):
            out.append((i, round(score, 6)))
    return sorted(out, key=lambda r: (-r[1], r[0]))


QUERIES = [["kinase"], ["atp binding"], ["binding atp|cat"], ["the", "cats"], ["the|zebra", "mat sat"], ["absent"], ["absent|cat", "the"], ["the the"], ["!!", "family"], ["kinases", "binds ATP|binding atp", "family"], [""]]


@pytest.mark.parametrize("most", [100_000, 0])
def test_search(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(postings, "TERMS", most)
    df = spark.createDataFrame(TEXTS, "id long, text string, title string").repartition(3)
    path = str(tmp_path / "x")
    index = postings.build(df, "id", {"body": F.col("text"), "name": F.col("title")}, path)
    assert index.groupBy("term", "field", "doc").count().filter("count > 1").count() == 0
    asked = postings.parsed(spark.createDataFrame(list(enumerate(QUERIES)), "q long, k array<string>"), "q", "k")
    weights = {"body": 1.0, "name": 2.5}
    got = {}
    for r in postings.search(path, asked, weights, 5).collect():
        got.setdefault(r["query"], []).append((r["rank"], r["doc"], r["score"]))
    for i, q in enumerate(QUERIES):
        assert [(d, pytest.approx(s, abs=2e-6)) for _, d, s in sorted(got.get(i, []))] == plain(q, weights)[:5], q
    empty = df.limit(0)
    postings.build(empty, "id", {"body": F.col("text"), "name": F.col("title")}, str(tmp_path / "none"))
    assert postings.search(str(tmp_path / "none"), asked, weights, 5).collect() == []


def test_stem(spark):
    some = ["families", "glasses", "boxes", "cats", "bus", "glass", "binding", "sing", "red", "bound", "species", "used", "ies", "sss", "watches", "added", "x-rays", "4ing", "a_bed", "bcding", "ys", "ees", "aes", "ching"]
    assert [stemmed(w) for w in some] == [plain_stem(w) for w in some]
    df = spark.createDataFrame([(w,) for w in some], "w string")
    assert {r[0]: r[1] for r in df.select("w", stem(F.col("w"))).collect()} == {w: plain_stem(w) for w in some}
