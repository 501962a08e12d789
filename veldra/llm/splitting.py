"""Cutting oversized texts at natural boundaries (problem 4).

Two ways over the same boundary masks, both for all texts of an Arrow batch at once:

``split_bisect``  recursive bisection: the strongest boundary near the midpoint, halves over limit minus overlap again, then overlaps.
``split_forward`` the rule of the project's data: from each start the strongest boundary late in the limit; the next start lies a
                  fixed overlap before it. Every start depends on the cut before it, which halving a text can't reproduce.

Defined results: null texts and texts within the limit give no row in ``split_forward`` and one piece in ``split_bisect`` (none
if null or empty); positions are code points of the text alone; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldra.functions.buffers import code_points, raw_bytes, slices, string_column

SLICE_BYTES = 8 << 20
#: Fixed values of the boundary rules.
SENTENCE_MARKS, WIDE_MARKS = ".!?", "。！？"


def boundaries(chars: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """Sorted cut positions, strongest kind first: behind a blank line, a line feed, a sentence end, a space or tab."""
    n = len(chars)
    row = np.zeros(n + 3, np.int64)
    np.add.at(row[:n], rows[:-1][rows[:-1] < n], 1)
    row = np.cumsum(row)
    row[n:] = -1
    padded = np.append(chars, [0, 0, 0])
    feed = padded == 10
    gap = (padded == 32) | (padded == 9)
    i = np.flatnonzero(feed[:n])
    same = row[i] == row[i + 1]
    two = i[same & feed[i + 1]] + 2
    three = i[same & (padded[i + 1] == 13) & feed[i + 2] & (row[i] == row[i + 2])] + 3
    stop = np.flatnonzero(np.isin(chars, [ord(c) for c in SENTENCE_MARKS]))
    stop = stop[gap[stop + 1] & (row[stop] == row[stop + 1])] + 2
    wide = np.flatnonzero(np.isin(chars, [ord(c) for c in WIDE_MARKS])) + 1
    return [np.union1d(two, three), i + 1, np.union1d(stop, wide), np.flatnonzero(gap[:n]) + 1]


def forward_pieces(rows: np.ndarray, kinds: list[np.ndarray], limit: int, overlap: int, least: int) -> tuple[np.ndarray, ...]:
    """Row, piece number, start and end of all pieces, by waves over the texts still open."""
    at = np.flatnonzero(np.diff(rows) > limit)
    start, number, out = rows[at], 0, []
    while len(at):
        end = rows[at + 1].copy()
        more = end - start > limit
        high = start[more] + limit
        cut = high.copy()
        open_ = np.ones(len(cut), bool)
        for positions in kinds:
            if len(positions):
                i = np.searchsorted(positions, high, "right") - 1
                best = positions[np.maximum(i, 0)]
                hit = open_ & (i >= 0) & (best >= high - limit + least)
                cut[hit] = best[hit]
                open_ &= ~hit
        end[more] = cut
        out.append((at, np.full(len(at), number), start - rows[at], end - rows[at]))
        at, start, number = at[more], cut - overlap, number + 1
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 4


def bisected_pieces(rows: np.ndarray, kinds: list[np.ndarray], limit: int, overlap: int) -> tuple[np.ndarray, ...]:
    """As forward_pieces, by bisection; every text with content has pieces."""
    at = np.flatnonzero(np.diff(rows) > 0)
    a, b, done = rows[at], rows[at + 1], []
    whole = b - a <= limit
    done.append((at[whole], a[whole], b[whole]))
    at, a, b = at[~whole], a[~whole], b[~whole]
    while len(at):
        middle, reach = (a + b) // 2, np.maximum((b - a) // 4, 1)
        cut, open_ = middle.copy(), np.ones(len(at), bool)
        for positions in kinds:
            if len(positions):
                i = np.searchsorted(positions, middle)
                up, down = positions[np.minimum(i, len(positions) - 1)], positions[np.maximum(i - 1, 0)]
                near = np.where(np.abs(up - middle) < np.abs(middle - down), up, down)
                hit = open_ & (np.abs(near - middle) <= reach) & (near > a) & (near < b)
                cut[hit] = near[hit]
                open_ &= ~hit
        at, a, b = np.concatenate([at, at]), np.concatenate([a, cut]), np.concatenate([cut, b])
        small = b - a <= limit - overlap
        done.append((at[small], a[small], b[small]))
        at, a, b = at[~small], a[~small], b[~small]
    at, a, b = (np.concatenate(x) for x in zip(*done))
    order = np.argsort(a, kind="stable")
    at, a, b = at[order], a[order], b[order]
    first = np.append(True, at[1:] != at[:-1])[: len(at)]
    number = np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
    return at, number, np.where(first, a, np.maximum(a - overlap, rows[at])) - rows[at], b - rows[at]


def _split(df: DataFrame, id_col: str, text_col: str, pieces) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = string_column(batch.column(1))
            for x, y in slices(np.diff(raw_bytes(text)[1]), SLICE_BYTES):
                chars, rows, _, _ = code_points(text.slice(x, y - x))
                at, number, start, end = pieces(rows, boundaries(chars, rows))
                columns = [batch.column(0).take(pa.array(at + x))] + [pa.array(v, pa.int32()) for v in (number, start, end)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "piece_no", "char_start", "char_end"])

    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(id_col, text_col).mapInArrow(run, f"id {kind}, piece_no int, char_start int, char_end int")
    return out.withColumnRenamed("id", id_col)


def split_forward(df: DataFrame, id_col: str = "row_id", text_col: str = "text", limit: int = 512, overlap: int = 50, least: int = 257) -> DataFrame:
    """``(id, piece_no, char_start, char_end)`` of each text over ``limit``; a cut leaves at least ``least`` characters."""
    if not 0 <= overlap < least <= limit:
        raise ValueError("overlap < least <= limit is needed")
    return _split(df.filter(F.length(text_col) > limit), id_col, text_col, lambda rows, kinds: forward_pieces(rows, kinds, limit, overlap, least))


def split_bisect(df: DataFrame, id_col: str = "row_id", text_col: str = "text", limit: int = 512, overlap: int = 50) -> DataFrame:
    """``(id, piece_no, char_start, char_end)`` of each text with content, no piece over ``limit``."""
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be under half the limit")
    return _split(df.filter(F.length(text_col) > 0), id_col, text_col, lambda rows, kinds: bisected_pieces(rows, kinds, limit, overlap))
