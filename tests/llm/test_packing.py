import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillstone.llm.packing import CAPACITY, cut, harmonic_pack, op3_pack_harmonic, word_ids

from .brute import docs, rows


def check(got, texts):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x in texts.items()}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    assert set(by_doc) == set(ids)
    for i, own in by_doc.items():
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids[i])
            assert r["ids_crc32"] == zlib.crc32(np.asarray(ids[i][at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids[i])
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= CAPACITY
    return sum(len(v) for v in ids.values()) / (CAPACITY * len(by_seq)) if by_seq else 1


@pytest.mark.parametrize("n", [1, 31, 32, 33, 700, 1000, 1025, 1500, 2047, 2048, 2049, 9999])
def test_cut(n):
    pieces = cut(n)
    assert sum(length for length, _ in pieces) == n
    assert all(length * j <= CAPACITY for length, j in pieces)


def test_awkward_rows(spark):
    from .brute import TEXTS

    check(rows(harmonic_pack(docs(spark).repartition(3))), dict(enumerate(TEXTS)))


def test_many_tails_and_partitions(spark):
    texts = [f"word{k} " * (1 + 37 * k % 900) for k in range(400)]
    assert check(rows(harmonic_pack(docs(spark, texts).repartition(7))), dict(enumerate(texts))) > 0.93


def test_tree_of_rests(spark, monkeypatch):
    """With two tasks a node: bins are filled on several levels, and no level leaves more than under `class` pieces a node."""
    monkeypatch.setattr("quillstone.llm.packing.FANOUT", 2)
    texts = [f"word{k} " * (1 + 37 * k % 300) for k in range(400)]
    got = rows(harmonic_pack(docs(spark, texts).repartition(9)))
    assert check(got, dict(enumerate(texts))) > 0.85
    levels = {(r["sequence_id"] - (1 << 56)) >> 52 for r in got if 1 << 56 <= r["sequence_id"] < 1 << 60}
    assert len(levels) > 1


def test_words_one_by_one():
    """Letters with and without marks, capitals that become two letters, combining marks and stops."""
    path = public_tokenizers.path("word_bpe_49k.json")
    t, encode, rng = Tokenizer.from_file(path), word_ids(path), random.Random(1)
    letters = [*map(chr, range(0xC0, 0x180)), *map(chr, range(0x300, 0x320)), *"abcXYZ'’.,!?;0123-ΣςǅsStdre "]
    for text in ["İ.", "İ,", "ŉ.", *("".join(rng.choices(letters, k=rng.randint(1, 9))) for _ in range(5000))]:
        assert np.frombuffer(encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_empty(spark):
    assert rows(harmonic_pack(docs(spark, []))) == []


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert check(rows(op3_pack_harmonic(spark, sf)), texts) > 0.95


def test_words_are_encoded_as_in_their_text():
    path = public_tokenizers.path("word_bpe_49k.json")
    t, encode = Tokenizer.from_file(path), word_ids(path)
    for x in ["Word. word, WORD ΟΔΟΣ. İx, é., e\u0301, can't. it's, 12. a.b, ., .. <|ENDOFTEXT|> <|endoftext|>. x<|startoftext|>", "Straße, ÉCOLE. İstanbul ŉo ªº µ ÿ Ÿ ŒUVRE ǅ ſ", "a\u00a0b,\tc.\x1cd. \u0301x", ""]:
        assert np.frombuffer(encode(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids
