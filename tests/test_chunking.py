import hashlib
import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veldra.functions import text as T
from veldra.functions.buffers import code_points
from veldra.operators import chunking, embed


def plain_recursive(text, seps, size, overlap):
    """Plain statement of the rule, for comparison."""
    if not seps:
        return [text]
    if seps[0] == "":
        return [text[i : i + size] for i in range(0, len(text), size - overlap)]
    pieces = []
    for part in text.split(seps[0]):
        pieces += [part] if len(part) <= size else plain_recursive(part, seps[1:], size, overlap)
    out = [pieces[0]]
    for p in pieces[1:]:
        if len(out[-1]) + len(p) <= size:
            out[-1] += p
        else:
            out.append(p)
    return out


TEXTS = ["", "a", "\n\n", "word " * 60, "x" * 95, "One. Two! Three? " * 9, "p1 line\nline two\n\np2. And so. on\n\n\n\np3", "日本語の文章。" * 12, "a\n" * 70, " " * 50]


@pytest.mark.parametrize("size,overlap", [(40, 5), (10, 0), (512, 50)])
def test_recursive(spark, size, overlap):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, None])], "doc_id int, text string")
    got = {}
    for r in chunking.chunk(df, size=size, overlap=overlap).orderBy("doc_id", "chunk_id").collect():
        got.setdefault(r["doc_id"], []).append(r)
    for i, t in enumerate(TEXTS):
        want = plain_recursive(t, chunking.SEPARATORS, size, overlap) if t else []
        assert [r["chunk"] for r in got.get(i, [])] == want
        at = 0
        for n, r in enumerate(got.get(i, [])):
            assert (r["chunk_id"], r["token_start"], r["token_end"]) == (n, at, at + len(r["chunk"]) // 4)
            at = r["token_end"]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab. \n", max_size=60), min_size=1, max_size=8))
def test_recursive_random(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    got = {r["doc_id"]: r["c"] for r in df.select("doc_id", chunking.recursive(F.col("text"), 12, 3).alias("c")).collect()}
    assert all(got[i] == plain_recursive(t, chunking.SEPARATORS, 12, 3) for i, t in enumerate(texts))


def cut(texts, separators, size, overlap):
    chars, at, _, _ = code_points(pa.array(texts, pa.large_string()))
    span, length, of, bounds = chunking._cut(chars, at[:-1], at[1:], separators, size, overlap)
    whole = "".join(map(chr, chars))
    out = [[] for _ in texts]
    for i, (s, n) in enumerate(zip(span, length)):
        piece = "".join(whole[a:b] for a, b in bounds[of == i])
        assert len(piece) == n
        out[s].append(piece)
    return out


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet="ab. \né", min_size=1, max_size=80), min_size=1, max_size=6), st.sampled_from([(12, 3), (5, 0), (2, 1), (30, 10)]), st.sampled_from([chunking.SEPARATORS, ("\n", " "), (". ", ""), ("\n\n\n", "aa", "")]))
def test_cut_of_batches(texts, sizes, separators):
    """All texts of a batch at once, against the plain statement."""
    assert cut(texts, separators, *sizes) == [plain_recursive(t, separators, *sizes) for t in texts]


def test_length_function(spark):
    """Pieces measured in words: the caller's function takes the place of the number of characters."""
    df = spark.createDataFrame([(0, "one two. three four. five six seven. eight")], "doc_id int, text string")
    words = lambda c: F.size(F.filter(F.split(c, " "), lambda x: x != ""))
    got = [r["chunk"] for r in chunking.chunk(df, size=4, overlap=0, separators=(". ",), length=words).orderBy("chunk_id").collect()]
    assert got == ["one twothree four", "five six seveneight"]


def test_fixed(spark):
    df = spark.createDataFrame([(0, "x" * 1000), (1, "ab"), (2, ""), (3, None)], "doc_id int, text string")
    got = [(r["doc_id"], len(r["chunk"])) for r in chunking.chunk(df, "fixed").orderBy("doc_id", "chunk_id").collect()]
    assert got == [(0, 512), (0, 512), (0, 76), (1, 2)]


def plain_semantic(text, dim=64, threshold=0.5, least=100, most=1000):
    some = [s.strip() for s in re.split(r"(?<=[.!?])\s+", text) if s.strip()]
    if len(some) <= 1:
        return [text]
    v = embed.hash_texts(some, dim)
    segments = [some[0]]
    for i in range(1, len(some)):
        if float(v[i] @ v[i - 1]) < threshold:
            segments.append(some[i])
        else:
            segments[-1] += " " + some[i]
    out = []
    for s in segments:
        if len(s) > most:
            out += [s[i : i + most] for i in range(0, len(s), most - least)]
        elif len(s) < least and out:
            out[-1] += " " + s
        else:
            out.append(s)
    return out


def test_semantic(spark):
    texts = ["One. Two! Three? " * 9, "The cat sat here now. The cat sat here then. " + "Other words follow in this one. " * 80, "single", "a. b", "Long. " + "w" * 2500 + ". End."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, "", None])], "doc_id int, text string")
    got = {}
    for r in chunking.chunk(df, "semantic").orderBy("doc_id", "chunk_id").collect():
        got.setdefault(r["doc_id"], []).append(r["chunk"])
    assert got == {i: plain_semantic(t) for i, t in enumerate(texts)}
    by_steps = {}
    for r in chunking.chunk(df, "semantic", steps=embed.hash_steps).orderBy("doc_id", "chunk_id").collect():
        by_steps.setdefault(r["doc_id"], []).append(r["chunk"])
    assert by_steps == got


def test_bad_parameters(spark):
    df = spark.createDataFrame([(0, "a")], "doc_id int, text string")
    with pytest.raises(ValueError):
        chunking.chunk(df, "unknown")
    with pytest.raises(ValueError):
        chunking.chunk(df, size=50, overlap=50)


def test_hashing(spark):
    df = spark.createDataFrame([("Red fish, red FISH",), ("",), (None,)], "text string")
    got = [r["embedding"] for r in embed.embed(df, "no such model").collect()]
    want = [0.0] * 64
    for w in ("red", "fish"):
        h = int(hashlib.md5(w.encode()).hexdigest()[:8], 16)
        want[h % 64] += 1.0 if h // 64 % 2 == 0 else -1.0
    n = sum(x * x for x in want) ** 0.5
    assert got[0] == pytest.approx([x / n for x in want]) and got[1] == [0.0] * 64 and got[2] is None


def test_text_functions(spark):
    rows = [("Document 1:  body \n\nDocument 2: x",), ("none",), ("Document 1: " + "y" * 600,), ("Document 1: only\n\nQuestion: q\nAnswer:",)]
    got = [r[0] for r in spark.createDataFrame(rows, "p string").select(T.fallback_answer(F.col("p"))).collect()]
    assert got == ["body", T.NO_ANSWER, "y" * 500 + "...", "only\n\nQuestion: q\nAnswer:"]
    kinds = [r[0] for r in spark.createDataFrame([("True",), ("12",), (" -1_0 ",), ("1e3",), ("abc",), ("",)], "v string").select(T.coerce_kind(F.col("v"))).collect()]
    assert kinds == ["bool", "int", "int", "float", "str", "str"]
