from pyspark.sql import functions as F

from quillstone.llm.sharding import _placer, op1_shard_prefix_sums, shard_by_bytes, write_shards

from .brute import crc, docs, rows


def check(got, want, n):
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in got) == sorted((i is None, i or 0, len((t or "").encode()) + 1, crc(t)) for i, t in want)
    total, largest = sum(r["size"] for r in got), max((r["size"] for r in got), default=0)
    for k in range(n):
        own = sorted((r for r in got if r["shard"] == k), key=lambda r: r["slot"])
        assert [r["slot"] for r in own] == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / n) <= largest
        assert [r["start"] for r in own] == sorted(r["start"] for r in own)
    by_start = sorted(got, key=lambda r: r["start"])
    assert [r["shard"] for r in by_start] == sorted(r["shard"] for r in got)


def test_awkward_rows(spark):
    from .brute import TEXTS

    ids = [None, None, 5, 5, 5, *range(10, 10 + len(TEXTS) - 5)]
    df = docs(spark, ids=ids).withColumn("size", F.lit("clash")).withColumn("pid", F.lit(1)).repartition(3)
    check(rows(shard_by_bytes(df, 3)), list(zip(ids, TEXTS)), 3)


def test_empty_and_single(spark):
    assert rows(shard_by_bytes(docs(spark, []))) == []
    assert [r["slot"] for r in rows(shard_by_bytes(docs(spark, ["x"])))] == [0]


def test_cuts_do_not_overflow():
    """Shards of 100 TB, more than 64-bit products hold."""
    import pyarrow as pa

    total, n = 10**14, 10**6
    start = [0, 10**8 - 1, total // 2, total - 5]
    b = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([1]), pa.array([0]), pa.array([0], pa.int32())], names=["doc_id", "size", "text_crc32", "pid"])
    for at in start:
        (out,) = _placer({0: (at, 0)}, total, n)([b])
        assert out.column("shard")[0].as_py() == (2 * at + 1) * n // (2 * total)


def test_hot_id(spark):
    texts = ["y" * (k % 7) for k in range(300)]
    check(rows(shard_by_bytes(docs(spark, texts, [1] * 150 + list(range(150))).repartition(5), 8)), list(zip([1] * 150 + list(range(150)), texts)), 8)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = rows(op1_shard_prefix_sums(spark, sf))
    want = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got} == {i: (len((t or "").encode()) + 1, crc(t)) for i, t in want}
    sizes = [sum(r["size"] for r in got if r["shard"] == k) for k in range(8)]
    assert max(sizes) - min(sizes) <= 2 * max(r["size"] for r in got)


def test_written_shards(spark, tmp_path):
    df = docs(spark)
    write_shards(df, str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == df.count() and set(df.columns) <= set(back.columns)


def test_written_shards_keep_every_row(spark, tmp_path):
    """Null and repeated ids, and columns of the layout's own names."""
    values = [(1, "a", 7, "x"), (1, "a", 7, "x"), (None, "bb", None, "y"), (2, None, 9, None), (None, "", 1, "z")]
    df = spark.createDataFrame(values, "doc_id long, text string, slot long, Shard string").repartition(2)
    write_shards(df, str(tmp_path / "out"), 2)
    back = rows(spark.read.parquet(str(tmp_path / "out")))
    assert sorted(((r["doc_id"], r["text"], r["slot"], r["Shard"]) for r in back), key=str) == sorted(values, key=str)
    for k in (0, 1):
        own = sorted(r["_slot"] for r in back if r["_shard"] == k)
        assert own == list(range(len(own)))


def test_written_shards_of_an_empty_table(spark, tmp_path):
    write_shards(docs(spark, []), str(tmp_path / "out"), 3)
