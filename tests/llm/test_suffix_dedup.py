import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.llm.suffix_dedup import Suffixes, find_anchors, op10_suffix_dedup, remove_repeats, report

from .brute import PASSAGE, TEXTS, docs, rows


def plain(pairs, length=100):
    """[(id, text)] with unique ids to {id: (n_bytes, n_removed, n_spans, sha, kept)}."""
    seen, out = set(), {}
    for i, text in sorted(pairs):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            w = data[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\x01" * length
            seen.add(w)
        left = bytes(c for c, g in zip(data, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(data), sum(gone), spans, hashlib.sha256(left).hexdigest(), left)
    return out


def messy(seed, n=60):
    rng = random.Random(seed)
    words = ["the", "of", "and", "straße", "été", "blend", "oneaen", "x"]
    shared = [" ".join(rng.choices(words, k=rng.randint(15, 60))) for _ in range(5)]
    out = []
    for _ in range(n):
        parts = [rng.choice(shared) if rng.random() < 0.5 else " ".join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(rng.randint(1, 6))]
        text = " ".join(parts)
        if rng.random() < 0.3 and out:
            base = rng.choice(out)
            k = rng.randint(0, len(base))
            text = base[:k] + rng.choice(["", "Z", "ZZ zz"]) + base[k + rng.randint(0, 2) :]
        out.append(text)
    return [*out, "ab" * 300, "ab" * 200, "q" * 1000, out[3], out[3]]


def got_of(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows(df)}


@pytest.mark.parametrize("most,together", [(50_000, 20_000), (1, 20_000), (1, 1), (1, 7)])
@pytest.mark.parametrize("parts", [1, 5])
def test_against_brute_force(spark, most, together, parts):
    """Also with all anchors as hot ones, in pieces, and with all pieces as large ones, in windows."""
    texts = messy(most + parts) + TEXTS
    random.Random(5).shuffle(texts)
    df = docs(spark, texts).withColumn("key", F.lit("clash")).withColumn("tie", F.lit(1)).repartition(parts)
    assert got_of(report(df, most=most, together=together)) == {i: v[:4] for i, v in plain(list(enumerate(texts))).items()}


@pytest.mark.parametrize("most", [50_000, 1])
@pytest.mark.parametrize("bits,rows_together", [(0, 500_000), (3, 1), (6, 1)])
def test_contexts_of_one_hash(spark, monkeypatch, bits, rows_together, most):
    """A context hash of few bits: equal hashes settle nothing before the bytes have been compared."""
    for name, value in (("CONTEXT_BITS", bits), ("ROWS", rows_together), ("BLOCK", 1000)):
        monkeypatch.setattr(f"quillstone.llm.suffix_dedup.{name}", value)
    rng = random.Random(6)
    shared = "".join(rng.choices("abc", k=40))
    texts = ["".join(rng.choices("abc", k=80)) + shared + "".join(rng.choices("abc", k=80)) for _ in range(60)] + messy(8, 30)
    assert got_of(report(docs(spark, texts).repartition(3), most=most)) == {i: v[:4] for i, v in plain(list(enumerate(texts))).items()}


def test_many_copies_of_one_text(spark, monkeypatch):
    """A text that many others claim to repeat is dealt over several keys."""
    monkeypatch.setattr("quillstone.llm.suffix_dedup.ROWS", 1)
    rng = random.Random(7)
    base = "".join(rng.choices("abcdefgh ", k=400))
    texts = [base] + [base[: (k := rng.randrange(400))] + "#" + base[k:] for _ in range(1500)]
    want = plain(list(enumerate(texts)))
    assert got_of(report(docs(spark, texts).repartition(8))) == {i: v[:4] for i, v in want.items()}


@pytest.mark.parametrize("rows_together", [500_000, 1])
@pytest.mark.parametrize("block", [1 << 18, 1])
def test_texts_of_many_tiles(spark, monkeypatch, block, rows_together):
    """A tile's border is no repeat, whether both sides are settled in one task's rows or after the shuffle."""
    for name, value in (("TILE", 300), ("BLOCK", block), ("ROWS", rows_together)):
        monkeypatch.setattr(f"quillstone.llm.suffix_dedup.{name}", value)
    rng = random.Random(3)
    clean = ["".join(rng.choices("abcdefghij ", k=n)) for n in (399, 400, 3000, 5000)]
    texts = [*clean, clean[2][900:1700] + clean[3], clean[3][:2000] * 2] + messy(4, 20)
    df = docs(spark, texts).repartition(2)
    got = got_of(report(df))
    assert got == {i: v[:4] for i, v in plain(list(enumerate(texts))).items()}
    assert [got[i][1] for i in range(4)] == [0] * 4


def test_suffix_order():
    rng = np.random.default_rng(1)
    for size in (1, 2, 37, 300):
        rows_, lens = rng.integers(0, 3, (size, 20)).astype(np.uint8), rng.integers(0, 21, size)
        starts = np.unique(np.concatenate([[0], rng.integers(0, size, 4)]))
        s = Suffixes(rows_, lens, starts)
        now, common = s.order()
        group = np.searchsorted(starts, np.arange(size), "right")
        assert [int(x) for x in now] == sorted(range(size), key=lambda i: (group[i], rows_[i, : lens[i]].tobytes(), i))
        plain_now, plain_common = s._plain(starts[group - 1])
        assert (now == plain_now).all() and (common == plain_common).all()


def test_hash_collisions_are_noticed():
    rows_ = np.array([[3, 1], [1, 2], [2, 0]], np.uint8)
    s = Suffixes(rows_, np.array([2, 2, 2]), np.array([0]))
    s.prefix[:] = 0
    now, common = s.order()
    assert now.tolist() == [1, 2, 0] and common.tolist() == [0, 0, 0]


def test_equal_windows_have_equal_anchors():
    a, b = b"qq" + PASSAGE.encode() * 2, b"zzzzzzzz" + PASSAGE.encode() * 2 + b"q" * 200
    segment, pos, low, high, key = find_anchors([a, b], 100, 32)
    of = {}
    for s, p, lo, hi, k in zip(segment, pos, low, high, key):
        for at in range(p - hi, p - lo + 1):
            of[s, at] = (p - at, k)
    assert len(of) == len(a) + len(b) - 198
    windows = {}
    for (s, at), anchor in of.items():
        assert windows.setdefault((a, b)[s][at : at + 100], anchor) == anchor


def test_repeated_ids_and_nulls(spark):
    texts, ids = [PASSAGE, PASSAGE, PASSAGE, "short", None, PASSAGE + "!"], [None, 7, 7, 7, 8, None]
    got = sorted(str((r["doc_id"], r["n_removed"])) for r in rows(report(docs(spark, texts, ids))))
    n = len(PASSAGE)
    null = sorted([0, n]) if sorted([PASSAGE, PASSAGE + "!"]) else []
    assert sorted(got)[:4] == sorted(["(7, 0)", f"(7, {n})", f"(7, {n})", "(8, 0)"])
    assert sorted(int(x.split(",")[1][:-1]) for x in got if x.startswith("(None")) == null
    assert rows(report(docs(spark, []))) == []


def test_cleaning(spark):
    texts = messy(9) + ["é" * 120, "a" + "é" * 120]
    clash = {c: F.lit(3) for c in ("packed", "doc", "tie", "key", "kind", "spans", "fulls", "first")}
    df = docs(spark, texts).withColumns(clash)
    want = plain(list(enumerate(texts)))
    got = {r["doc_id"]: (r["text"], r["n_chars"], r["packed"]) for r in rows(remove_repeats(df))}
    assert got == {i: (t := v[4].decode("utf-8", "ignore"), len(t), 3) for i, v in want.items()}


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    pairs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got_of(op10_suffix_dedup(spark, sf)) == {i: v[:4] for i, v in plain(pairs).items()}
