"""Tiles, counts and cells against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.operators import retrieval
from quillstone.plans import searches

SF = "/root/testdata/sf0.01"
SCHEMA = "id long, vector array<float>, kind int"


@pytest.fixture(scope="module")
def some(spark):
    """Ties, repeated vectors, one hot vector and rows without any."""
    rng = np.random.default_rng(4)
    m = np.round(rng.normal(size=(400, 6)), 1).astype(np.float32)
    m[100:240] = m[100]
    data = [(int(i), [float(x) for x in v], int(i) % 3) for i, v in enumerate(m)] + [(900, None, 1), (901, [], 1)]
    return m, spark.createDataFrame(data, SCHEMA).repartition(5)


def plain_order(m, q):
    s = [sum(float(x) * float(y) for x, y in zip(m[q], v)) for v in m]
    return [i for i in sorted(range(len(m)), key=lambda i: (-s[i], i)) if i != q]


@pytest.mark.parametrize("queries,size", [(16_384, 32_768), (7, 60)])
def test_nearest(spark, some, monkeypatch, queries, size):
    monkeypatch.setattr(retrieval, "QUERIES", queries)
    monkeypatch.setattr(retrieval, "ROWS", size)
    monkeypatch.setattr(retrieval, "SCORES", 500)
    m, df = some
    got = {}
    for r in retrieval.nearest(df.filter("id % 5 = 0 OR id >= 900"), df, 7).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["id"]
    assert sorted(got) == list(range(0, 400, 5))
    for q, found in got.items():
        assert [found[k] for k in range(1, 8)] == plain_order(m, q)[:7]
    assert retrieval.nearest(df.limit(0), df, 3).collect() == [] == retrieval.nearest(df, df.limit(0), 3).collect()


@pytest.mark.parametrize("fan", [64, 2])
def test_quality_by_counts(spark, some, monkeypatch, fan):
    monkeypatch.setattr(retrieval, "FAN_IN", fan)
    monkeypatch.setattr(retrieval, "ROWS", 90)
    monkeypatch.setattr(retrieval, "ENTRIES", 100)
    monkeypatch.setattr(retrieval, "QUERIES", 30)
    m, df = some
    alone = spark.createDataFrame([(500, [0.0] * 6, 77)], SCHEMA)  # none is relevant, and it is no row itself
    asked = df.filter("id % 7 = 0").unionByName(alone)
    got = {r["query_id"]: r for r in retrieval.quality_by_counts(asked, df).collect()}
    assert sorted(got) == [*range(0, 400, 7), 500]
    assert (got[500]["ap"], got[500]["mrr"], got[500]["auc"], got[500]["n_relevant"]) == (0.0, 0.0, 0.0, 0)
    for q in range(0, 400, 7):
        ranks = [n + 1 for n, i in enumerate(plain_order(m, q)) if i % 3 == q % 3]
        p, n = len(ranks), 399 - len(ranks)
        want = np.mean([(k + 1) / r for k, r in enumerate(ranks)]), 1 / ranks[0], (p * n - (sum(ranks) - p * (p + 1) / 2)) / (p * n)
        assert got[q]["n_relevant"] == p
        assert np.allclose([got[q]["ap"], got[q]["mrr"], got[q]["auc"]], want)


def test_no_ranking_is_made(spark):
    plan = searches.retrieval_map_mrr_auc(spark, SF)._jdf.queryExecution().toString()
    assert "Window" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_counts_are_not_shuffled(spark, some, tmp_path, monkeypatch):
    """What is written is the rows once and a row for each unit of a query; chunks of queries are tasks of their own."""
    monkeypatch.setattr(retrieval, "shared_folder", lambda spark, name: f"{tmp_path}/{name}", raising=False)
    monkeypatch.setattr(retrieval, "ENTRIES", 2000)
    m, df = some
    judged = retrieval.quality_by_counts(df.filter("id % 5 = 0"), df)
    assert "CoGroup" not in judged._jdf.queryExecution().toString()
    found = spark.read.parquet(f"{tmp_path}/quality/found")
    assert found.count() == 80 and found.select(F.input_file_name()).distinct().count() > 3
    assert spark.read.parquet(f"{tmp_path}/quality/rows").count() == 400
    assert len(list(tmp_path.glob("*/*"))) == 3


def test_macro_means_shuffle_no_counts(spark):
    assert "CoGroup" not in searches.macro_level_mean(spark, SF)._jdf.queryExecution().toString()


def test_quality_of_wide_numbers_and_unknown_kinds(spark):
    rows = [(i, [float(i) / 3, 1.0], None if i % 4 == 0 else i % 2) for i in range(12)] + [(20, [2.0, 1e-9], 1), (-7, [2.0, 1e-9], 1)]
    df = spark.createDataFrame(rows, "id long, vector array<double>, kind int")
    got = {r["query_id"]: r for r in retrieval.quality_by_counts(df.filter("id in (4, 5, 6)").withColumn("vector", F.col("vector").cast("array<float>")), df).collect()}
    assert (got[4]["ap"], got[4]["n_relevant"]) == (0.0, 0)
    for q in (5, 6):
        asked = [float(np.float32(x)) for x in rows[q][1]]
        order = [k for *_, k in sorted(((-(asked[0] * v[0] + asked[1] * v[1]), i, k) for i, v, k in rows if i != q), key=lambda x: x[:2])]
        ranks = [n + 1 for n, k in enumerate(order) if k == q % 2]
        assert got[q]["n_relevant"] == len(ranks) and np.isclose(got[q]["ap"], np.mean([(k + 1) / r for k, r in enumerate(ranks)])) and np.isclose(got[q]["mrr"], 1 / ranks[0])


def test_inverted_file(spark, some, tmp_path, monkeypatch):
    monkeypatch.setattr(retrieval, "ROWS", 50)
    monkeypatch.setattr(retrieval, "QUERIES", 10)
    m, df = some
    centres = retrieval.inverted_file(df, str(tmp_path / "x"), cells=12)
    assert centres.count() == 12
    assert spark.read.parquet(str(tmp_path / "x/rows")).count() == 400  # every row is indexed
    full = retrieval.probe(df.filter("id % 5 = 0"), str(tmp_path / "x"), 7, probes=12)
    got = {}
    for r in full.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"]))
    assert all([i for _, i in sorted(got[q])] == plain_order(m, q)[:7] for q in range(0, 400, 5))
    few = retrieval.probe(df.filter("id = 0"), str(tmp_path / "x"), 7, probes=2)
    read = few._jdf.queryExecution().toString().split("PartitionFilters: [")[1].split("]")[0]
    assert "cell#" in read and " IN " in read or "cell#" in read and " = " in read  # other cells' folders are not read


def test_recall(spark):
    """At least 0.9 of the ten nearest, over the whole table."""
    for sf in (SF, "/root/testdata/sf0.1"):
        exact = {(r["query_id"], r["id"]) for r in searches.knn_topk(spark, sf).collect()}
        found = {(r["query_id"], r["id"]) for r in searches.inverted_file_topk(spark, sf).collect()}
        assert len(exact & found) >= 0.9 * len(exact)


def test_hash_of_a_place_is_even(spark):
    df = spark.range(0, 5000, 1, 4).select(F.lit(1).alias("id")).withColumn("g", retrieval._place(10))
    assert max(r["count"] for r in df.groupBy("g").count().collect()) < 700
