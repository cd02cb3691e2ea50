import hashlib
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quillstone.llm.warc import ARCHIVE, data_start, members, op2_warc_zip, parse, read_packages, record, write_packages

from .brute import rows

BIG, OTHER = "<p>é" + "x" * 1200, "y" * 1000
VALUES = [(1, "http://a", BIG), (2, "http://b\r\nX: y", BIG), (9, None, BIG), (9, "http://c", BIG), (None, "d", BIG), (3, "e", None), (4, "f", ""), (5, "g", "small"), (6, "h", "small"), (7, "i", OTHER), (8, "j", "\r\n\r\nWARC/1.1"), (None, "k", "z" * 2000), (None, "l", "z" * 2000)]


def want(values):
    top = {}
    for i, _, h in values:
        if i is not None:
            top[h] = max(top.get(h, i), i)
    for i, u, h in values:
        data = (h or "").encode()
        other = len(data) >= 1000 and h in top and i != top[h]
        yield i, u, "revisit" if other else "response", top[h] if other else None, len(data), hashlib.sha1(data).hexdigest(), None if other else data


@pytest.mark.parametrize("limit", [1 << 20, 1])
def test_round_trip(spark, tmp_path, limit):
    df = spark.createDataFrame(VALUES, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("n", F.lit(1)).repartition(3)
    packages = write_packages(df, f"file://{tmp_path}/p", limit=limit)
    back = read_packages(packages, range_bytes=limit)
    key = lambda r: str(r)
    got = [tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in back.collect()]
    assert sorted(got, key=key) == sorted(want(VALUES), key=key)
    assert packages.count() == (len(VALUES) if limit == 1 else packages.count())
    for r in packages.collect():
        with zipfile.ZipFile(r.package.removeprefix("file://")) as z:
            assert z.testzip() is None and {i.compress_type for i in z.infolist()} == {zipfile.ZIP_STORED}


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert rows(read_packages(write_packages(df, f"file://{tmp_path}/p"))) == []


def test_directories():
    for force in (False, True):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.comment = b"PK\x05\x06 no" if not force else b"note"
            z.writestr("other.txt", "q" * 50, zipfile.ZIP_DEFLATED)
            with z.open(ARCHIVE, "w", force_zip64=force) as f:
                f.write(b"hello")
        if not force:
            out = io.BytesIO(out.getvalue().replace(b"PK\x05\x06 no", b"comment...")[: len(out.getvalue())])
        found = members(out, len(out.getvalue()))
        assert set(found) == {ARCHIVE}
        out.seek(data_start(out, found[ARCHIVE][0]))
        assert out.read(found[ARCHIVE][1]) == b"hello"
    with pytest.raises(ValueError):
        members(io.BytesIO(b"nothing here"), 12)


def test_zip64_end_record():
    """A ZIP64 end record and locator, with the small fields filled up."""
    import struct

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(ARCHIVE, b"data")
    data = out.getvalue()
    end = data.rfind(b"PK\x05\x06")
    n, size, start = struct.unpack_from("<10xHII", data, end)
    big = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, n, n, size, start)
    data = data[:end] + big + struct.pack("<4sIQI", b"PK\x06\x07", 0, end, 1) + struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    assert set(members(io.BytesIO(data), len(data))) == {ARCHIVE}


def test_damage_is_noticed():
    good = record(1, "u", b"abc", hashlib.sha1(b"abc").hexdigest(), None)
    assert parse(good)[-1] == b"abc"
    with pytest.raises(ValueError):
        parse(good.replace(b"abc\r\n", b"abd\r\n"))


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    pages = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    got = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in rows(op2_warc_zip(spark, sf))}
    assert got == {i: x for i, _, *x in ((w[0], w[1], *w[2:6]) for w in want(pages)) for x in [tuple(x)]}


def test_ranges_are_read_by_many_tasks(spark, tmp_path):
    """However few bytes name a range, adaptive execution must not join them into one task."""
    df = spark.createDataFrame([(i, "u", f"{i}" * 700) for i in range(400)], "page_id long, url string, html string").repartition(4)
    back = read_packages(write_packages(df, f"file://{tmp_path}/p"), range_bytes=100)
    assert back.rdd.getNumPartitions() > 8 and back.count() == 400
