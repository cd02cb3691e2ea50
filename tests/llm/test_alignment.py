import hashlib
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillstone.llm import alignment
from quillstone.llm.alignment import align_tokens, ending, op13_align_tokenizers, slices
from quillstone.llm.common import worker_cache

from .brute import TEXTS, docs

A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
SF = "/root/testdata/sf0.001"


def byte_of():
    """The letters of the byte-level vocabulary, by asking the tokenizer's own decoder."""
    out = {}
    for token, i in A.get_vocab().items():
        if len(token) == 1:
            raw = A.decode([i], skip_special_tokens=False)
            if raw != "�":
                out[token] = raw.encode()
    return out


def token_bytes(text):
    """Ends of the tokens on both sides, by walking the text's own bytes: both sides cover them in order."""
    want = b" " + text.encode()
    a = A.encode(" " + text, add_special_tokens=False)
    b = B.encode(text)
    pieces = [B.id_to_piece(i) for i in b]
    raw = [bytes([int(p[3:5], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces)]
    if b"".join(raw) != want:
        return [], [], [], []
    return a.ids, [len(t) for t in a.tokens], b, [len(r) for r in raw]


def brute(texts):
    """The contract by comparing every A token's end with every B token's end."""
    out, links, count = [], [], Counter()
    for text in texts:
        a, na, b, nb = token_bytes(text) if text else ([], [], [], [])
        ea, eb = [sum(na[: k + 1]) for k in range(len(na))], [sum(nb[: k + 1]) for k in range(len(nb))]
        linked = [(x, y) for x, e in zip(a, ea) for y, f in zip(b, eb) if e == f]
        groups, i, k = [], 0, 0
        for e in sorted(set(ea) & set(eb)):
            j, m = max(p for p, x in enumerate(ea) if x == e) + 1, max(p for p, x in enumerate(eb) if x == e) + 1
            groups.append(",".join(map(str, a[i:j])) + "|" + ",".join(map(str, b[k:m])))
            i, k = j, m
        links.append(linked)
        count.update(linked)
        out.append([len(a), len(b), len(groups), len(linked), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""])
    top = defaultdict(int)
    for (_, y), n in count.items():
        top[y] = max(top[y], n)
    return [(n_a, n_b, g, n, sum(count[p] == top[p[1]] for p in linked), sum(count[p] for p in linked), sha) for (n_a, n_b, g, n, sha), linked in zip(out, links)], count


def results(df):
    return sorted((str(r["doc_id"]), *(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"))) for r in df.collect())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=12), st.lists(st.integers(0, 3), min_size=1, max_size=12))
def test_slices(a, b):
    """Groups and links of any sizes, tokens without bytes among them."""
    if sum(a) != sum(b):
        a, b = [*a, max(0, sum(b) - sum(a))], [*b, max(0, sum(a) - sum(b))]
    ea, eb = [sum(a[: k + 1]) for k in range(len(a))], [sum(b[: k + 1]) for k in range(len(b))]
    cut = slices(a, b)
    assert [ea[j - 1] for _, j, _, _ in cut] == sorted(set(ea) & set(eb)) and cut[-1][1] == len(a) and cut[-1][3] == len(b)
    got = sorted((x, y) for i, j, k, m in cut if sum(a[i:j]) or i == 0 for x in range(ending(a, i, j), j) for y in range(ending(b, k, m), m))
    if min(a) > 0 and min(b) > 0:
        assert got == sorted((x, y) for x, e in enumerate(ea) for y, f in enumerate(eb) if e == f)


def test_rows(spark):
    """Nulls, empty and long texts, special strings, control and rare letters, repeated rows, a null id, other columns."""
    texts = TEXTS[:9] + ["x" * 300, "word " * 200, *TEXTS[11:], "▁ no", "\x00\x01 tab\t", "😀 漢字 ﬁ", "<|endoftext|>", "a\r\nb", "  two  ", "<0x41>", "<unk> <s>"]
    ids = [None, 5, 5, *range(3, len(texts))]
    df = docs(spark, texts, ids).withColumn("pair", F.lit(1)).withColumn("row", F.lit(2)).repartition(3)
    want, count = brute(texts)
    for frequent in (3, 1_000_000):
        rows, pairs = align_tokens(df, frequent=frequent)
        assert results(rows) == sorted((str(i), *w) for i, w in zip(ids, want))
    assert {(r["a_id"], r["b_id"]): r["n"] for r in pairs.collect()} == count
    assert sum(w[0] > 0 for w in want) > 12


def test_letters():
    from quillstone.llm.alignment import byte_letters

    letters = byte_letters()
    assert sorted(letters.values()) == list(range(256))
    assert all(bytes([letters[t]]) == raw for t, raw in byte_of().items())


def test_long_text_and_empty_table(spark):
    text = "long words 漢字 of a text\n" * 20_000
    got = align_tokens(docs(spark, [text]))[0].first()
    assert got["n_groups"] == got["n_links"] > 100_000 and got["count_sum"] > got["n_links"]
    assert align_tokens(docs(spark, []))[0].collect() == []


def test_query(spark):
    """The short texts of the table by brute force over all ends; counts over the corpus by a second way for all."""
    got = {r["doc_id"]: r for r in op13_align_tokenizers(spark, SF).collect()}
    source = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert set(got) == set(source)
    count, linked = Counter(), {}
    for i, text in source.items():
        a, na, b, nb = token_bytes(text) if text else ([], [], [], [])
        ends, at = {}, 0
        for x, n in zip(a, na):
            at += n
            ends[at] = x
        at, linked[i] = 0, []
        for y, n in zip(b, nb):
            at += n
            if at in ends:
                linked[i].append((ends[at], y))
        count.update(linked[i])
    top = defaultdict(int)
    for (_, y), n in count.items():
        top[y] = max(top[y], n)
    for i, pairs in linked.items():
        assert (got[i]["n_links"], got[i]["n_best"], got[i]["count_sum"]) == (len(pairs), sum(count[p] == top[p[1]] for p in pairs), sum(count[p] for p in pairs))
    short = sorted(source, key=lambda i: (len(source[i]), i))[:60]
    for i, w in zip(short, brute([source[i] for i in short])[0]):
        assert (got[i]["n_a"], got[i]["n_b"], got[i]["n_groups"], got[i]["n_links"], got[i]["groups_sha256"]) == (*w[:4], w[6])


def peak_mb(run):
    tracemalloc.start()
    try:
        out = run()
        return out, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_memory_of_pairs():
    """A batch of Arrow's 10,000 rows with 3,000,000 pairs is summed in less memory than all of them take, and what was kept for encoding is gone by then."""
    pairs, times = np.tile(np.arange(300_000), 10), np.ones(3_000_000, np.int32)
    ends = pa.array(np.arange(0, 3_000_001, 300, np.int32))
    batch = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.array(x)) for x in (pairs, times)], names=["pairs", "times"])
    worker_cache("aligned")["tokenizers"] = {"young": {"part": ()}}
    out, mb = peak_mb(lambda: list(alignment._sums(iter([batch]))))
    total = Counter()
    for b in out:
        total.update(dict(zip(b.column("pair").to_pylist(), b.column("n").to_pylist())))
    assert set(total) == set(range(300_000)) and set(total.values()) == {10}
    assert mb < 110
    assert not worker_cache("aligned")
    got = list(alignment.pairs_of(iter([batch])))
    assert max(len(p) for _, p, _ in got) <= alignment.SLICE_PAIRS and sum(b.num_rows for b, _, _ in got) == 10_000
    assert np.array_equal(np.concatenate([p for _, p, _ in got]), pairs)


def test_memory_of_parts():
    """What is found for a part of some ten letters takes little memory."""
    s = alignment.sides()
    parts = [hashlib.md5(b"%d" % k).hexdigest()[:10].translate(str.maketrans("0123456789", "ghijklmnop")) for k in range(20_000)]
    tracemalloc.start()
    try:
        found = s.found(parts)
        kept = tracemalloc.get_traced_memory()[0] / len(parts)
    finally:
        tracemalloc.stop()
    assert len(found) == len(parts) and kept < 350


def test_parts_together():
    """Parts encoded many at a time give what each gives by itself, also beside parts that no other may be joined to or whose bytes differ."""
    s = alignment.sides()
    words = {p for t in TEXTS for p in s.parts(t or "") if p}
    parts = sorted(words | {"a\u2581", "\u2581", "\u2581b", " two", "two ", "\n", "\nx", "x\n", "'s", "x'", "\x1c", "\x1dy", "\u3000", "z\u00a0", "<s>", "<|endoftext|>", "é", "漢", "12", "."})
    found = s.found(parts)
    assert set(found) == set(parts) and sum(x is None for x in found.values()) >= 3
    for p in parts:
        a, na, b, nb = token_bytes(p)
        if not a:
            assert found[p] is None
            continue
        want, _ = brute([p])
        groups, links = found[p][3], np.frombuffer(found[p][4], np.int64)
        assert (*found[p][:3], len(links), hashlib.sha256(groups).hexdigest()) == (*want[0][:4], want[0][6])
        ends = {sum(na[: k + 1]): x for k, x in enumerate(a)}
        assert links.tolist() == [ends[e] << 32 | y for k, y in enumerate(b) if (e := sum(nb[: k + 1])) in ends]


def test_sliced():
    batch = pa.RecordBatch.from_arrays([pa.array(range(6))], names=["x"])
    assert [b.column(0).to_pylist() for b in alignment.sliced(batch, np.array([1, 2, 9, 0, 3, 1]), 3)] == [[0, 1], [2], [3, 4], [5]]
    assert list(alignment.sliced(batch.slice(0, 0), np.zeros(0, int), 3)) == []
