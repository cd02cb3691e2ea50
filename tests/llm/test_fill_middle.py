import hashlib
import re

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstone.llm.fill_middle import ORACLES, BlockTree, fill_in_middle, op12_fill_middle_fenwick, restored

from .brute import TEXTS, docs, rows

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)
SF = "/root/testdata/sf0.001"


def plain(i, text):
    """The contract in words, over lists of units."""
    text = text or ""
    w, x = UNIT.findall(text), hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(x[k : k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (len(w) + 1), h[1] % (len(w) + 1)))
    pre, mid, suf = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(w), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(w), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(w), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("abZ 漢\n<>é😀9"), max_size=60), st.integers(1, 9))
def test_cuts(text, block):
    units, tree = UNIT.findall(text), BlockTree(text.encode(), block)
    assert (tree.units, tree.points) == (len(units), len(text))
    for k in range(len(units) + 1):
        head = "".join(units[:k])
        assert tree.cut(k) == (len(head.encode()), len(head))


def test_rows(spark):
    """Nulls, empty and long texts, markers, parts of markers, repeated rows, a null id, one more column and clashing ones."""
    texts = TEXTS + ["has <M> inside", "x<<S", "<P", "<", "é" * 9000 + " end " + "letters" * 3000, "a<S"] + [f"w{k} 漢<" * 40 for k in range(300)]
    ids = [None, 7, 7] + list(range(3, len(texts)))
    df = docs(spark, texts, ids).withColumn("form", F.lit("mine")).withColumn("row", F.lit(3)).repartition(3)
    out = fill_in_middle(df)
    got = out.withColumn("back", restored(out["output"], out["form"]))
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "row", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got.collect()), key=str)
    assert got == sorted(((i, *plain(i, t)) for i, t in zip(ids, texts)), key=str)
    back = out.withColumn("back", restored(out["output"], out["form"])).select("doc_id", "back").collect()
    assert sorted((str(r[0]), r[1]) for r in back) == sorted((str(i), t or "") for i, t in zip(ids, texts))
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_empty_table_and_other_names(spark):
    assert fill_in_middle(docs(spark, [])).collect() == []
    df = spark.createDataFrame([(1, "one two three")], "k long, body string")
    r = fill_in_middle(df, "k", "body", seed=3, markers=("[p]", "[s]", "[m]"), plain=0, spm=100).first()
    assert r["form"] == "spm" and sorted(re.sub(r"\[.\]", "", r["output"])) == sorted("one two three")


def test_query(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    cur = con.execute(ORACLES["op12_fill_middle_fenwick"])
    names = [d[0] for d in cur.description]
    want = sorted((dict(zip(names, r)) for r in cur.fetchall()), key=str)
    df = op12_fill_middle_fenwick(spark, SF)
    assert df.columns == names
    assert sorted((r.asDict() for r in df.collect()), key=str) == want
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all(r["restored_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in rows(df))
