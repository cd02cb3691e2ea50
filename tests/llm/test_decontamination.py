import pytest
from pyspark.sql import functions as F

from quillstone.llm.decontamination import decontaminate, op5_decontaminate_ngrams, report, window_tables

from .brute import PASSAGE, TEXTS, contamination, docs, rows, sha

ITEMS = [(10, PASSAGE), (9, "seven wizards brew"), (9, "seven wizards brew"), (3, None), (4, ""), (5, "..."), (None, "lazy dog"), (7, "word word"), (8, " ".join(PASSAGE.split()[3:18])), (11, "straße école")]


def items(spark, values=ITEMS):
    return spark.createDataFrame(values, "item_id long, text string")


@pytest.mark.parametrize("block", [500_000, 5])
def test_against_brute_force(spark, block):
    got = rows(report(docs(spark).withColumn("spans", F.lit(1)).repartition(3), items(spark), block_windows=block), "doc_id")
    want = contamination(TEXTS, [x for x in ITEMS if x[1]])
    for r in got:
        n, hit, found = want[r["doc_id"]]
        found.discard(None)
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (n, hit, len(found), sha(found), hit > 0)
    assert len(got) == len(TEXTS)


CLASH = ("spans", "items", "n_words", "row", "item_id", "doc", "table")


@pytest.mark.parametrize("block", [500_000, 5])
def test_columns_of_any_name(spark, block):
    df = docs(spark, TEXTS, [None, 7, 7] + list(range(3, len(TEXTS)))).withColumns({c: F.lit(c) for c in CLASH})
    for how in ("documents", "spans"):
        left = rows(decontaminate(df, items(spark, ITEMS[:1]), how, block_windows=block))
        assert all(r[c] == c for r in left for c in CLASH)
        assert len(left) == (len(TEXTS) if how == "spans" else len(TEXTS) - sum(h > 0 for _, h, _ in contamination(TEXTS, ITEMS[:1])))


def test_tables_keep_their_bound(spark):
    """A long item is cut; every window is in one table, and no table has more than it may."""
    import pickle

    long = " ".join(f"w{k}" for k in range(500))
    tables = [pickle.loads(r["table"]) for r in rows(window_tables(items(spark, [(1, long), *ITEMS]), block_windows=40))]
    sizes = [sum(len(hashes) for hashes, _, _ in t["sizes"].values()) for t in tables]
    assert max(sizes) <= 40 and sum(len(t["sizes"].get(10, [()])[0]) for t in tables) >= 491
    got = rows(report(docs(spark, [long, "x " + long[:-5] + " y"]), items(spark, [(1, long), *ITEMS]), block_windows=40), "doc_id")
    assert [(r["n_words"], r["n_hit"], r["n_items"]) for r in got] == [(500, 500, 1), (501, 499, 1)]


def test_empty_tables(spark):
    assert not any(r["contaminated"] for r in rows(report(docs(spark), items(spark, []))))
    assert rows(report(docs(spark, []), items(spark))) == []


@pytest.mark.parametrize("block", [500_000, 5])
def test_cleaning(spark, block):
    df = docs(spark)
    with pytest.raises(ValueError):
        decontaminate(df, items(spark), "all")
    left = decontaminate(df, items(spark, ITEMS[:1]), "documents", block_windows=block)
    want = contamination(TEXTS, ITEMS[:1])
    assert {r["doc_id"] for r in rows(left)} == {i for i, (_, hit, _) in enumerate(want) if not hit}
    spans = rows(decontaminate(docs(spark), items(spark, ITEMS[:1]), "spans", block_windows=block), "doc_id")
    texts = {r["doc_id"]: r["text"] for r in spans}
    assert texts[8] == "Intro words here.  And an end." and texts[6] == "" and texts[5] == TEXTS[5]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet").collect()
    rows_in = read("documents")
    want = contamination([r.text for r in rows_in], [(r.item_id, r.text) for r in read("benchmark")])
    want = {r.doc_id: (n, h, len(f), sha(f), h > 0) for r, (n, h, f) in zip(rows_in, want)}
    got = rows(op5_decontaminate_ngrams(spark, sf))
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got} == want
