import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstone.llm.token_counts import count_tokens, lengths, model, op4_token_counts_two_tier, pre_tokens

from .brute import TEXTS, docs, rows

SP = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab ▁\n\té <s>/1漢\x00"), max_size=30))
def test_pre_tokens_add_up(text):
    assert sum(lengths(model(None), pre_tokens(text))) == len(SP.encode(text))


def test_awkward_rows(spark):
    got = rows(count_tokens(docs(spark).repartition(3), limit=100))
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got} == {i: (len((t or "").encode()), n := len(SP.encode(t or "")), n > 100) for i, t in enumerate(TEXTS)}


def test_empty_and_small_table(spark):
    assert rows(count_tokens(docs(spark, []))) == []
    got = rows(count_tokens(docs(spark, ["b a a", "a"] * 20, [None] * 40), frequent=1))
    assert {r["n_tokens"] for r in got} == {1, 3} and len(got) == 40


def test_long_pre_tokens(spark):
    """They are in neither tier, so neither grows with them."""
    texts = ["y" * 5000 + " a", "漢" * 300, " " * 400 + "b " + "z" * 65, "a " * 50 + "q" * 64]
    got = rows(count_tokens(docs(spark, texts)))
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {i: len(SP.encode(t)) for i, t in enumerate(texts)}


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r["n_tokens"] for r in rows(op4_token_counts_two_tier(spark, sf))}
    assert got == {r.doc_id: len(SP.encode(r.text or "")) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def test_summaries_of_many_tasks(spark, monkeypatch):
    """The tree's depth grows with the tasks, its nodes do not."""
    from quillstone.llm import token_counts

    monkeypatch.setattr(token_counts, "FANOUT", 3)
    got = token_counts.frequent_pre_tokens(docs(spark, [f"a w{i % 4}" for i in range(60)]).repartition(29))
    assert got == {"▁a": 60} | {f"▁w{i}": 15 for i in range(4)}
