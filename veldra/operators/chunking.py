"""Chunking: recursive by separators, fixed windows, semantic by sentence similarity.

Chunk columns: chunk_id from 0 in each document, text, token_start and token_end as running sums of length // 4. Null and empty
texts have no chunks. The recursive way drops separators where it merges, and overlaps only windows cut by characters; it works on
the boundary masks of all texts of an Arrow batch at once, or as a column expression where lengths are measured by a caller's function.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldra.functions.buffers import code_points, ranges, raw_bytes, slices, string_column

#: Separators, strongest first; the empty one stands for windows of characters.
SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def _check(size: int, overlap: int) -> None:
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be under the chunk size")


def windows(text: Column, size: int, step: int) -> Column:
    """Windows of ``size`` characters every ``step``; none for an empty text."""
    n = F.length(text)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1, F.lit(step)), lambda i: F.substring(text, i + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def merge_small(pieces: Column, size: int, length: Callable[[Column], Column] = F.length) -> Column:
    """Neighbouring pieces joined from left to right while their length stays within ``size``."""
    state = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def step(a: Column, x: Column) -> Column:
        first = F.struct(a["done"].alias("done"), x.alias("open"))
        joined = F.struct(a["done"].alias("done"), F.concat(a["open"], x).alias("open"))
        closed = F.struct(F.array_append(a["done"], a["open"]).alias("done"), x.alias("open"))
        return F.when(a["open"].isNull(), first).when(length(a["open"]) + length(x) <= size, joined).otherwise(closed)

    return F.aggregate(pieces, state, step, lambda a: F.array_append(a["done"], a["open"]))


def recursive(text: Column, size: int = 512, overlap: int = 50, separators: tuple[str, ...] = SEPARATORS, length: Callable[[Column], Column] = F.length) -> Column:
    """Chunks of a text as an array; the expression is nested once for each separator. Windows are cut by characters whatever ``length`` measures."""
    _check(size, overlap)
    if not separators:
        return F.array(text)
    if separators[0] == "":
        return windows(text, size, size - overlap)
    parts = F.split(text, "\\Q" + separators[0] + "\\E", -1)
    deeper = F.transform(parts, lambda p: F.when(length(p) <= size, F.array(p)).otherwise(recursive(p, size, overlap, separators[1:], length)))
    return merge_small(F.flatten(deeper), size, length)


def _places(chars: np.ndarray, separator: str, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the separator stands in the spans, from left to right without overlap, and in which span."""
    codes = [ord(c) for c in separator]
    n = len(chars) - len(codes) + 1
    hit = np.ones(max(n, 0), bool)
    for i, c in enumerate(codes):
        hit &= chars[i : i + n] == c
    at = np.flatnonzero(hit)
    span = np.searchsorted(start, at, "right") - 1
    inside = (span >= 0) & (at + len(codes) <= end[np.maximum(span, 0)])
    at, span = at[inside], span[inside]
    if len(codes) > 1 and len(at) and len(set(codes)) == 1:
        # of a run of overlapping hits every second one (third, ...) counts
        fresh = np.append(True, (at[1:] != at[:-1] + 1) | (span[1:] != span[:-1]))
        place = np.arange(len(at))
        keep = (place - np.maximum.accumulate(np.where(fresh, place, 0))) % len(codes) == 0
        at, span = at[keep], span[keep]
    return at, span


def _merged(owner: np.ndarray, length: np.ndarray, size: int) -> np.ndarray:
    """Number of the chunk of each piece (owners in order): pieces of an owner joined from left to right up to ``size``; all owners go on together."""
    upto = np.append(0, np.cumsum(length))
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(owner))
    begins = np.zeros(len(owner), bool)
    at = first
    while len(at):
        begins[at] = True
        # the piece that begins a chunk is in it, whatever its length
        stop = np.minimum(np.maximum(np.searchsorted(upto, upto[at] + size, "right") - 1, at + 1), last)
        more = stop < last
        at, last = stop[more], last[more]
    return np.cumsum(begins) - 1


def _cut(chars: np.ndarray, start: np.ndarray, end: np.ndarray, separators: tuple[str, ...], size: int, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Chunks of spans of ``chars``: of each chunk its span and length; and the parts it is made of: their chunk and start (with lengths by ``np.diff`` of ends)."""
    if not separators:
        span = np.arange(len(start))
        return span, end - start, span, np.stack([start, end], 1)
    if separators[0] == "":
        step = size - overlap
        many = -(-(end - start) // step)
        span = np.repeat(np.arange(len(start)), many)
        a = start[span] + ranges(np.zeros(len(start), np.int64), many) * step
        b = np.minimum(a + size, end[span])
        return span, b - a, np.arange(len(span)), np.stack([a, b], 1)
    at, span = _places(chars, separators[0], start, end)
    owner = np.concatenate([np.arange(len(start)), span])
    a, b = np.concatenate([start, at + len(separators[0])]), np.concatenate([end, at])
    # parts lie between separators: a part begins where its span does or behind a separator, and ends before the next
    order = np.lexsort((a, owner))
    owner, a = owner[order], a[order]
    b = b[np.lexsort((b, np.concatenate([np.arange(len(start)), span])))]
    small = b - a <= size
    part = np.arange(len(a))
    deep = np.flatnonzero(~small)
    d_span, d_length, d_chunk, d_bounds = _cut(chars, a[deep], b[deep], separators[1:], size, overlap) if len(deep) else (np.zeros(0, np.int64),) * 3 + (np.zeros((0, 2), np.int64),)
    # pieces: small parts as they are, and the chunks of the larger ones, in order of place
    p_part = np.concatenate([part[small], deep[d_span]]) if len(deep) else part[small]
    p_length = np.concatenate([(b - a)[small], d_length])
    order = np.argsort(p_part, kind="stable")
    where = np.empty(len(order), np.int64)
    where[order] = np.arange(len(order))
    chunk = _merged(owner[p_part[order]], p_length[order], size)
    chunk_of = chunk[where]
    few = int(small.sum())
    bounds = np.concatenate([np.stack([a[small], b[small]], 1), d_bounds])
    of = np.concatenate([chunk_of[:few], chunk_of[few:][d_chunk]]) if len(deep) else chunk_of
    order2 = np.lexsort((bounds[:, 0], of))
    firsts = np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1])) if len(chunk) else np.zeros(0, np.int64)
    lengths = np.add.reduceat(p_length[order], firsts) if len(firsts) else np.zeros(0, np.int64)
    return owner[p_part[order]][firsts], lengths, of[order2], bounds[order2]


SLICE_BYTES = 8 << 20


def recursive_chunks(rows: DataFrame, keep: tuple[str, ...], text_col: str, size: int = 512, overlap: int = 50, separators: tuple[str, ...] = SEPARATORS) -> DataFrame:
    """``keep`` columns and ``(chunk_id, chunk, token_start, token_end)`` of each chunk of texts that aren't empty."""
    _check(size, overlap)
    kept = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = string_column(batch.column(kept))
            for x, y in slices(np.diff(raw_bytes(text)[1]), SLICE_BYTES):
                chars, at, byte_at, data = code_points(text.slice(x, y - x))
                some = np.flatnonzero(np.diff(at) > 0)
                span, length, of, bounds = _cut(chars, at[some], at[some + 1], separators, size, overlap)
                if not len(span):
                    continue
                a, b = byte_at[bounds[:, 0]], byte_at[bounds[:, 1]]
                buffer = np.ascontiguousarray(data[ranges(a, b - a)])
                ends = np.append(0, np.cumsum(np.bincount(of, (b - a).astype(np.float64), len(span)).astype(np.int64)))
                chunk = pa.LargeStringArray.from_buffers(len(span), pa.py_buffer(ends), pa.py_buffer(buffer)).cast(pa.string())
                new = np.append(True, span[1:] != span[:-1])
                number = np.arange(len(span))
                number -= np.maximum.accumulate(np.where(new, number, 0))
                tokens = np.cumsum(length // 4)
                before = tokens - length // 4
                base = np.maximum.accumulate(np.where(new, before, 0))
                row = pa.array(some[span] + x)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(row) for i in range(kept)), pa.array(number, pa.int32()), chunk, pa.array(before - base), pa.array(tokens - base)], names)

    names = [f"_k{i}" for i in range(kept)] + ["chunk_id", "chunk", "token_start", "token_end"]
    picked = rows.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], text_col)
    kinds = ", ".join(f"_k{i} {picked.schema[i].dataType.simpleString()}" for i in range(kept))
    out = picked.mapInArrow(run, ", ".join(filter(None, [kinds, "chunk_id int, chunk string, token_start bigint, token_end bigint"])))
    return out.withColumnsRenamed({f"_k{i}": c for i, c in enumerate(keep)})


def fixed(text: Column, size: int = 512, overlap: int = 50) -> Column:
    _check(size, overlap)
    return windows(text, size, size - overlap)


def fold_segments(segments: Column, least: int, most: int) -> Column:
    """Sizes of semantic segments put right: long ones cut into windows, short ones joined to the chunk before."""
    none = F.array().cast("array<string>")

    def step(a: Column, s: Column) -> Column:
        cut = F.concat(a, windows(s, most, most - least))
        joined = F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.concat(F.element_at(a, -1), F.lit(" "), s)))
        return F.when(F.length(s) > most, cut).when((F.length(s) < least) & (F.size(a) > 0), joined).otherwise(F.array_append(a, s))

    return F.aggregate(segments, none, step)


def semantic(text: Column, some: Column, steps: Column, threshold: float = 0.5, least: int = 100, most: int = 1000) -> Column:
    """Chunks of sentences of like meaning; ``some``: the sentences of the text as a column of their own, ``steps``: the similarity of each to the one before."""
    state = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def step(a: Column, i: Column) -> Column:
        sentence = F.get(some, i)
        split = (i > 0) & (F.get(steps, i) < threshold)
        fresh = F.struct(F.array_append(a["done"], a["open"]).alias("done"), sentence.alias("open"))
        more = F.struct(a["done"].alias("done"), F.concat_ws(" ", a["open"], sentence).alias("open"))
        return F.when(split, fresh).otherwise(more)

    segments = F.aggregate(F.sequence(F.lit(0), F.size(some) - 1), state, step, lambda a: F.array_append(a["done"], a["open"]))
    return F.when(F.size(some) <= 1, F.array(text)).otherwise(fold_segments(segments, least, most))


STRATEGIES = {"recursive": recursive, "fixed": fixed}


def chunk(df: DataFrame, strategy: str = "recursive", text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), **params) -> DataFrame:
    """One row per chunk: the ``keep`` columns, chunk_id INT, chunk, token_start and token_end BIGINT. ``length`` (Column to Column) measures pieces of the recursive way otherwise than in characters."""
    if strategy not in (*STRATEGIES, "semantic"):
        raise ValueError(f"unknown chunking strategy: {strategy}")
    if strategy == "semantic":
        return semantic_chunks(df, text_col, keep, **params)
    if strategy == "recursive" and "length" not in params:
        return recursive_chunks(df.filter(F.length(text_col) > 0), keep, text_col, **params)
    rows = df.filter(F.length(text_col) > 0).select(*keep, STRATEGIES[strategy](F.col(text_col), **params).alias("chunks"))
    return number_chunks(rows, keep)


def semantic_chunks(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), steps=None, **params) -> DataFrame:
    """Semantic chunks; ``steps`` maps a column of sentence arrays to the similarities of neighbours (of hashed words by default).

    With the default the sentences of all texts of an Arrow batch are hashed at once; else the expressions above are used.
    """
    from veldra.functions.text import sentences

    rows = df.filter(F.length(text_col) > 0)
    if steps is not None:
        rows = rows.select(*keep, F.col(text_col).alias("_text"), sentences(F.col(text_col)).alias("_some")).withColumn("_steps", steps(F.col("_some")))
        rows = rows.select(*keep, semantic(F.col("_text"), F.col("_some"), F.col("_steps"), **params).alias("chunks"))
    else:
        rows = _semantic_rows(rows, keep, text_col, **params)
    return number_chunks(rows, keep)


#: White space as the expressions know it.
BEHIND_STOP, OUTER = re.compile(r"(?<=[.!?])\s+", re.ASCII), " \t\n\r\x0b\x0c"


def _semantic_rows(rows: DataFrame, keep: tuple[str, ...], text_col: str, threshold: float = 0.5, least: int = 100, most: int = 1000, dim: int = 64) -> DataFrame:
    """``keep`` columns and the array ``chunks`` of texts that aren't empty."""
    from veldra.operators.embed import hash_texts

    kept = len(keep)

    def pieces(text: str, some: list[str], split: list[bool]) -> list[str]:
        if len(some) <= 1:
            return [text]
        segments: list[list[str]] = []
        for sentence, fresh in zip(some, split):
            if fresh:
                segments.append([])
            segments[-1].append(sentence)
        out: list[str] = []
        for s in map(" ".join, segments):
            if len(s) > most:
                out += [s[i : i + most] for i in range(0, len(s), most - least)]
            elif len(s) < least and out:
                out[-1] += " " + s
            else:
                out.append(s)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = string_column(batch.column(kept))
            for x, y in slices(np.diff(raw_bytes(every)[1]), SLICE_BYTES):
                texts = every.slice(x, y - x).to_pylist()
                some = [[s for s in (p.strip(OUTER) for p in BEHIND_STOP.split(t)) if s] for t in texts]
                ends = np.cumsum([len(z) for z in some])
                v = hash_texts([s for z in some for s in z], dim)
                split = np.ones(len(v), bool)
                split[1:] = np.einsum("ij,ij->i", v[1:], v[:-1]) < threshold
                split[ends[:-1][ends[:-1] < len(v)]] = True
                split = split.tolist()
                chunks = [pieces(t, z, split[e - len(z) : e]) for t, z, e in zip(texts, some, ends.tolist())]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(x, y - x) for i in range(kept)), pa.array(chunks, pa.list_(pa.string()))], names)

    names = [f"_k{i}" for i in range(kept)] + ["chunks"]
    picked = rows.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], text_col)
    kinds = ", ".join([*(f"_k{i} {picked.schema[i].dataType.simpleString()}" for i in range(kept)), "chunks array<string>"])
    return picked.mapInArrow(run, kinds).withColumnsRenamed({f"_k{i}": c for i, c in enumerate(keep)})


def number_chunks(rows: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Numbered rows of an array column ``chunks`` that is never empty; offsets are folded within the array, without a window.

    The outer form of the explode keeps the optimizer from inferring a filter on the array's size, which would evaluate it twice.
    """
    sizes = F.transform("chunks", lambda c: F.expr("0L") + F.floor(F.length(c) / 4))
    starts = F.aggregate(sizes, F.array(F.lit(0).cast("bigint")), lambda a, x: F.array_append(a, F.element_at(a, -1) + x))
    out = rows.withColumn("starts", starts).select(*keep, "starts", F.posexplode_outer("chunks").alias("chunk_id", "chunk"))
    return out.select(*keep, "chunk_id", "chunk", F.get("starts", F.col("chunk_id")).alias("token_start"), F.get("starts", F.col("chunk_id") + 1).alias("token_end"))
