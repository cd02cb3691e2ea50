import zlib

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from quillstone.llm.packing import cut
from quillstone.llm.quality import Gam, features_of

from .brute import DOCS, contamination, rows
from .test_packing import check
from .test_simhash_similar import jaccard, shingles
from .test_suffix_dedup import plain

SF = "/root/testdata/sf0.001"


def good_ids(spark, texts):
    """The classifier over plain arrays."""
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    ids = sorted(i for i in labels if i in texts and zlib.crc32(str(i).encode()) % 5)
    x = {i: features_of((t or "").encode()) for i, t in texts.items()}
    model = Gam(np.array([x[i] for i in ids]), np.array([labels[i] for i in ids], float))
    return {i for i in texts if model.score(np.array([x[i]]))[0] >= 0.3}


def first_of_groups(texts, least):
    ids, sets = sorted(texts), {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in ids}
    for i in ids:
        for j in ids:
            if j < i and jaccard(sets[i], sets[j]) >= least:
                a, b = root[i], root[j]
                root = {k: min(a, b) if v in (a, b) else v for k, v in root.items()}
    return {i for i in ids if root[i] == i}


def test_stages_and_run(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    texts, df = {r.doc_id: r.text for r in documents.collect()}, documents
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, SF)
        assert df.columns == documents.columns
        got = {r["doc_id"]: r for r in rows(df)}
        if name == "quality":
            want = good_ids(spark, texts)
        elif name == "near_duplicates":
            want = first_of_groups(texts, 0.8)
        elif name == "repeated_passages":
            cut_ = plain(list(texts.items()))
            texts, want = {i: v[4].decode("utf-8", "ignore") for i, v in cut_.items()}, set(texts)
        else:
            hit = contamination(list(texts.values()), items)
            want = {i for i, (_, n, _) in zip(texts, hit) if not n}
        assert (name, set(got)) == (name, want)
        texts = {i: texts[i] for i in want}
        assert {i: r["text"] for i, r in got.items()} == texts
        assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    packed = rows(stages["packing"](spark, df, SF))
    assert check(packed, texts) > 0.9
    whole = rows(__spark_entry__.queries()["pipeline"](spark, SF))
    key = lambda r: (r["doc_id"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, whole)) == sorted(map(key, packed))
    assert len(whole) == sum(len(cut(r["doc_tokens"])) for r in whole if r["start"] == 0)


@pytest.mark.parametrize("n", [0, 3])
def test_awkward_documents(spark, n):
    df = spark.createDataFrame([(1, None, None, None, None), (None, "", "x", "y", 0), (2, "a b " * 400, "en", "s", 5)][:n], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, SF)
    df.collect()
