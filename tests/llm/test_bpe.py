from pathlib import Path

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veldra.llm import bpe

pytestmark = pytest.mark.skipif(not Path(bpe.TOKENIZER).exists(), reason="no tokenizer file")
HARD = ["", " ", "  ", "\n", "a\n\n b", "don't 'tis I'll'd 's's", " 'll '' 's !!'s", "aaaa aaaaaaa", "\x1c\x1da \x85b c", "x <|endoftext|> y", "٣٤ ½ ²", "é日本語 テスト　全角", "'re'v 'l", "a'", "👩‍👩‍👧 ok", "﻿x", "\t\tx", " \n x", "x'S", "\0a\0", "a" * 20_000, "=" * 3000]


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.load_merges())


@pytest.fixture(scope="module")
def library():
    t = pytest.importorskip("tokenizers").Tokenizer.from_file(bpe.TOKENIZER)
    t.encode_special_tokens = True
    return lambda texts: [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def test_hard_texts(encoder, library):
    assert encoder.encode(pa.array(HARD)).to_pylist() == library(HARD)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(blacklist_categories=("Cs", "Cn")), st.sampled_from(" '\nstrevdlmaeé日12.,")), max_size=40), max_size=6))
def test_random_texts(encoder, library, texts):
    assert encoder.encode(pa.array(texts, pa.string())).to_pylist() == library(texts)


def test_small_slices(library, monkeypatch):
    monkeypatch.setattr(bpe, "SLICE_BYTES", 7)
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    own = bpe.Encoder(bpe.load_merges())
    for _ in range(2):
        assert own.encode(pa.array(HARD)).to_pylist() == library(HARD)


@pytest.mark.parametrize("shared,longest,at_once", [(500_000, 48, 200_000), (3, 48, 2), (0, 48, 1), (500_000, 2, 5)])
def test_corpus_words(spark, library, monkeypatch, shared, longest, at_once):
    """Words known to all workers, or only some of them, or none: the same ids."""
    for name, value in (("SHARED_WORDS", shared), ("WORD_BYTES", longest), ("REPLAYED", at_once)):
        monkeypatch.setattr(bpe, name, value)
    df = spark.createDataFrame(list(enumerate(HARD + HARD[:5])), "doc_id int, text string").repartition(3)
    got = {r["doc_id"]: list(r["ids"]) for r in bpe.encode_texts(spark, df).collect()}
    assert [got[i] for i in range(len(got))] == library(HARD + HARD[:5])


def test_words_of_corpus(spark, library):
    df = spark.createDataFrame([("a b a",), ("b  a",), (None,), ("",)], "text string").repartition(2)
    rows = bpe.corpus_words(df, "text", spark.sparkContext.broadcast(bpe.load_merges())).collect()
    assert {bytes(r["word"]).decode(): r["n"] for r in rows} == {"a": 1, " b": 1, " a": 2, "b": 1, " ": 1}
    assert all(list(r["ids"]) == library([bytes(r["word"]).decode()])[0] for r in rows)


def test_operator(spark, library):
    rows = [(1, "hello world", 5), (1, "hello world", 5), (2, None, 1), (3, "", 1), (4, "  ", 1), (None, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    got = sorted(((r["doc_id"], list(r["ids"])) for r in bpe.encode_texts(spark, df).collect()), key=str)
    assert got == sorted(((i, library([t])[0] if t else []) for i, t, _ in rows), key=str)
    assert sorted(r["n_tokens"] for r in bpe.token_counts(spark, df).collect()) == sorted(len(ids) for _, ids in got)
    assert bpe.encode_texts(spark, df.limit(0)).count() == 0
