import hashlib
import re

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstone.llm import line_dedup
from quillstone.llm.common import file_system
from quillstone.llm.cuckoo import CuckooFilter
from quillstone.llm.line_dedup import ORACLES, LineIndex, apply_index, dedup_lines, op11_line_dedup_cuckoo

from .brute import TEXTS, docs

SF = "/root/testdata/sf0.001"


def key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), re.sub(r"^[ \t-\r]+|[ \t-\r]+$", "", line))


def plain(pairs):
    """(id, n_lines, n_dropped, text) by the contract; a null id comes after all others."""
    pairs = [(2**63 - 1 if i is None else i, t) for i, t in pairs]
    holders = {}
    for i, t in pairs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, t in pairs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(h := holders.get(key(x), ())) > 1 and i > min(h))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def results(df):
    return sorted((2**63 - 1 if r["doc_id"] is None else r["doc_id"], r["n_lines"], r["n_dropped"], r["text"] or "") for r in df.collect())


def made(n, seed=3):
    """Texts of few lines each; some lines common to many, in other case and with blanks around."""
    rng = np.random.default_rng(seed)
    return ["\n".join([("  Shared LINE number %d\t" if rng.random() < 0.3 else "shared line number %d") % x if x < 40 else f"own line {rng.integers(10**9)} of its text" for x in rng.integers(0, 60, rng.integers(1, 9))]) for _ in range(n)]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 3000), st.floats(0, 1))
def test_filter(seed, n, part):
    """None inserted is denied, also after the removal of others; over-full and colliding filters too."""
    low = np.random.default_rng(seed).integers(-(2**63), 2**63 - 1, n)
    low[: n // 7] = low[0]  # distinct keys with one fingerprint
    f = CuckooFilter.sized(n // 2)
    f.insert(low)
    assert f.contains(low).all() and len(f) == n
    gone = int(n * part)
    f.remove(low[:gone])
    f = CuckooFilter.of_bytes(f.to_bytes())
    assert f.contains(low[gone:]).all() and len(f) == n - gone
    f.remove(low[gone:])
    assert len(f) == 0


def test_filter_affirms_few_others():
    rng = np.random.default_rng(1)
    f = CuckooFilter.sized(100_000)
    f.insert(rng.integers(-(2**63), 2**63 - 1, 100_000))
    assert f.contains(rng.integers(-(2**63), 2**63 - 1, 100_000)).mean() < 0.0005 and not len(f.spare)


def test_rows(spark):
    """Nulls, empty and long texts, ties, repeated rows and ids, a null id, more columns and clashing ones."""
    texts = TEXTS + ["tiny line\nA line to share", "a LINE to share \r\nÄ line to share", "ä line to share\nÄ line to share", "\n".join(f"line {k} of a long text" for k in range(30_000)), "x\nline 7 of a long text\ny"] + made(200)
    ids = [7, 7, None, None] + list(range(4, len(texts)))
    df = docs(spark, texts, ids).withColumn("n_lines", F.lit("mine")).withColumn("row", F.lit(1)).withColumn("key", F.lit(2)).repartition(5)
    out = dedup_lines(df)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "row", "key", "n_lines", "n_dropped"]
    assert results(out) == plain(zip(ids, texts))
    assert dedup_lines(docs(spark, [])).collect() == []
    assert results(dedup_lines(docs(spark, ["only one line here"]))) == [(0, 1, 0, "only one line here")]


@pytest.mark.parametrize("keys,marks", [(3, False), (1_000_000, True)])
def test_in_and_out(spark, monkeypatch, keys, marks):
    """Insertions and deletions in turn; with filters dealt over more shards, and with filters that affirm all."""
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", keys)
    monkeypatch.setattr(line_dedup, "SHARDS", 2)
    if marks:  # one fingerprint and one pair of buckets: every answer has to be mended by the exact table
        monkeypatch.setattr(CuckooFilter, "_at", lambda self, low: (np.ones(len(low), np.uint16), np.zeros(len(low), np.uint64)))
    texts = made(90)
    rows = list(enumerate(texts))
    index = LineIndex(spark)

    def frame(ids):
        return docs(spark, [texts[i] for i in ids], list(ids))

    def same(ids):
        ids = list(ids)
        assert results(apply_index(index, frame(ids))) == plain([rows[i] for i in ids])
        live = {k for i in ids for k in map(key, texts[i].split("\n")) if len(k) >= 10}
        assert index.filters().agg(F.sum("held")).first()[0] == len(live) == index.counts().count()

    index.insert(frame(range(30, 60)))
    same(range(30, 60))
    index.insert(frame(range(0, 30)))  # owners change
    same(range(0, 60))
    before = sorted(map(tuple, index.counts().collect()))
    index.insert(frame(range(60, 90)))
    same(range(0, 90))
    index.delete(spark.createDataFrame([(i,) for i in range(60, 90)] + [(999,)], "i long"))
    same(range(0, 60))
    assert sorted(map(tuple, index.counts().collect())) == before  # undone
    index.delete(spark.createDataFrame([(i,) for i in range(0, 20)], "i long"))  # owners leave
    same(range(20, 60))
    index = LineIndex(spark, index.path)  # opened again
    index.insert(frame(range(0, 20)))
    same(range(0, 60))
    if keys == 3:
        assert index.shards > 2


def test_broken_generation_is_written_over(spark):
    index = LineIndex(spark)
    index.insert(docs(spark, ["the first line of all", "the first line of all"]))
    docs(spark, ["junk"]).write.parquet(index._where(1, "postings"))
    docs(spark, ["junk"]).write.parquet(index._where(1, "counts"))
    index = LineIndex(spark, index.path)
    index.insert(docs(spark, ["THE FIRST LINE OF ALL"], [2]))
    assert [tuple(r)[2:] for r in index.counts().collect()] == [(3, 0, 2)]


def test_filters_spare_the_exact_table(spark):
    """Only keys that a filter affirms meet the counts of earlier generations."""
    index = LineIndex(spark)
    index.insert(docs(spark, [f"line number {k} of the first" for k in range(500)] + ["one that both have"]))
    index.insert(docs(spark, [f"line number {k} of the second" for k in range(500)] + ["one that both have"], range(1000, 1501)))
    asked = spark.read.parquet(index._where(1, "counts"))
    assert asked.count() == 501 and asked.filter("refs > 1").count() == 1


def test_file_systems():
    assert file_system("/tmp/x")[1] == "/tmp/x" and file_system("file:/tmp/x")[1] == "/tmp/x" and file_system("dbfs:/a/b")[1] == "/dbfs/a/b"


def test_long_group_of_drops(spark):
    """Many drops a partition, in several files and row groups, out of few partitions."""
    texts = ["\n".join(f"line {k} of all of these texts" for k in range(j, 3000)) for j in range(40)]
    assert results(dedup_lines(docs(spark, texts).coalesce(2), increments=3)) == plain(enumerate(texts))


def test_query(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    cur = con.execute(ORACLES["op11_line_dedup_cuckoo"])
    names = [d[0] for d in cur.description]
    df = op11_line_dedup_cuckoo(spark, SF)
    assert df.columns == names
    got = sorted(map(tuple, df.collect()))
    assert got == sorted(cur.fetchall())
    source = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got == [(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in plain(source)]
    assert sum(r[2] for r in got) > 0


