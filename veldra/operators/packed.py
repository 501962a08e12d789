"""Several values packed in one field (problem 1).

The code points of a whole Arrow batch are scanned at once: masks for escapes, protected terms, separators and quotes (paired by
position, doubled quotes by run parity) give the value spans; values leave as list arrays with offsets derived from the spans and
are flattened with the ordinals of their parents. One pass, no shuffle; the terms are a bounded, checked driver-side list.

Defined results: null fields, empty fields and fields of mere separators give no row; empty values take no position; repeated
values and repeated rows are kept; a quote without partner is ordinary text; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from veldra.functions.buffers import code_points, ranges, raw_bytes, slices, string_column

#: Marks and words that stand between values, brackets around a list.
MARKS = ";,|/+&\n\r\t•·，、；・／＆｜"
WORDS = ("and", "et", "und", "y")
DASHES = "-–—"
BRACKETS = {"[": "]", "{": "}", "(": ")"}
QUOTES = "\"'"
END = 0  # stands behind each row
MOST_TERMS = 10_000
SLICE_BYTES = 8 << 20


def _is(chars: np.ndarray, some: str) -> np.ndarray:
    return np.isin(chars, [ord(c) for c in some])


def term_pattern(terms: list[str]) -> re.Pattern | None:
    """Finds protected terms, the longest first, in any letter case, not within a longer word."""
    some = sorted({t.strip() for t in terms if t and t.strip()}, key=lambda t: (-len(t), t))
    return re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, some)) + r")(?!\w)", re.IGNORECASE) if some else None


def _fill(n: int, spans: list[tuple[int, int]]) -> np.ndarray:
    mask = np.zeros(n + 1, np.int32)
    if spans:
        a, b = np.array(spans).T
        np.add.at(mask, a, 1)
        np.add.at(mask, b, -1)
    return np.cumsum(mask)[:n] > 0


def _neighbours(solid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest solid position at or before each position (-1 if none), and at or behind it (n if none)."""
    n = len(solid)
    index = np.arange(n)
    return np.maximum.accumulate(np.where(solid, index, -1)), np.minimum.accumulate(np.where(solid, index, n)[::-1])[::-1]


def _quoted(chars: np.ndarray, quote: np.ndarray, edge_before: np.ndarray, edge_after: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Opening and closing positions of the quoted spans; ``edge_*``: only blanks lie between the position and a border of values."""
    opens, closes = [], []
    n = len(chars)
    for q in QUOTES:
        is_q = quote & (chars == ord(q))
        at = np.flatnonzero(is_q)
        if not len(at):
            continue
        first = at[edge_before[at]]
        opener = np.zeros(n, bool)
        opener[first] = True
        # runs of the quote, the opener apart: an odd run before a border ends with the closing quote
        head = is_q & ~opener & ~np.append(False, (is_q & ~opener)[:-1])
        tail = is_q & ~opener & ~np.append((is_q & ~opener)[1:], False)
        a, b = np.flatnonzero(head), np.flatnonzero(tail)
        last = b[((b - a) % 2 == 0) & edge_after[b]]
        # a mark that could open may also close an earlier one
        last = np.union1d(last, first[edge_after[first]])
        if not len(last):
            continue
        i = np.searchsorted(last, first, "right")
        has = i < len(last)
        first, end = first[has], last[i[has]]
        same = row[first] == row[end]
        opens.append(first[same])
        closes.append(end[same])
    if not opens:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.concatenate(opens), np.concatenate(closes)
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    while len(a) > 1:
        bad = np.append(False, a[1:] <= b[:-1])
        worst = bad & ~np.append(False, bad[:-1])
        if not worst.any():
            break
        a, b = a[~worst], b[~worst]
    return a, b


def value_lists(column, terms: re.Pattern | None = None, marks: str = MARKS, words: tuple[str, ...] = WORDS) -> pa.LargeListArray:
    """The values of each row of a string column; null and empty rows have none."""
    column = pc.binary_join_element_wise(string_column(column), pa.scalar("", pa.large_string()), pa.scalar(chr(END), pa.large_string()))
    chars, rows, _, data = code_points(column)
    n = len(chars)
    if not n:
        return pa.array([[] for _ in range(len(column))], pa.large_list(pa.string()))
    text = data.tobytes().decode("utf-8")
    index = np.arange(n)
    ends = rows[1:] - 1
    border = np.zeros(n, bool)
    border[ends] = True
    row = np.repeat(np.arange(len(ends)), np.diff(rows))
    blank = _is(chars, " \t\n\r\f\v 　   ")
    # a backslash behind an even number of backslashes escapes what follows in its row
    slash = chars == 92
    run_start = np.maximum.accumulate(np.where(slash, -1, index)) + 1
    escapes = slash & ((index - run_start) % 2 == 0) & ~np.append(border[1:], True)
    escaped = np.append(False, escapes[:-1])
    term = _fill(n, [m.span() for m in terms.finditer(text)]) if terms else np.zeros(n, bool)
    free = ~escaped & ~escapes & ~term & ~border
    mark = _is(chars, marks) & free
    # words and dashes separate between blanks or other separators
    word = _fill(n, [m.span() for m in re.finditer(rf"(?<![^\s{re.escape(marks)}])(?:{'|'.join(words)})(?!\S)", text, re.IGNORECASE)]) if words else np.zeros(n, bool)
    word &= free & (row == row[np.maximum(index - 1, 0)]) & (index > 0)
    outer = blank | mark | border
    dash = _is(chars, DASHES) & free & np.append(True, outer[:-1]) & np.append(outer[1:], True)
    sep = mark | word | dash
    # brackets around the whole row
    before, after = _neighbours(~blank)
    head, tail = after[rows[:-1]], np.where(ends > 0, before[np.maximum(ends - 1, 0)], 0)
    for a, b in BRACKETS.items():
        both = (chars[head] == ord(a)) & (chars[np.maximum(tail, 0)] == ord(b)) & (tail > head) & ~escaped[np.maximum(tail, 0)]
        sep[head[both]] = sep[tail[both]] = True
    edge = sep | border
    before, after = _neighbours(~blank | sep)
    edge_before = np.append(True, np.where(before[:-1] >= 0, edge[before[:-1]], True) | (row[np.maximum(before[:-1], 0)] != row[1:]))
    edge_after = np.append(np.where(after[1:] < n, edge[np.minimum(after[1:], n - 1)], True), True)
    quote = _is(chars, QUOTES) & ~escaped
    opening, closing = _quoted(chars, quote, edge_before, edge_after, row)
    drop = escapes.copy()
    if len(opening):
        inside = _fill(n, list(zip((opening + 1).tolist(), closing.tolist())))
        sep &= ~inside
        kind = np.zeros(n, np.uint32)
        at = ranges(opening, closing - opening + 1)
        kind[at] = np.repeat(chars[opening], closing - opening + 1)
        twin = inside & quote & (chars == kind)
        start = twin & ~np.append(False, twin[:-1])
        since = index - np.maximum.accumulate(np.where(start, index, 0))
        drop |= twin & (since % 2 == 0) & np.append(twin[1:], False)
        drop[opening] = drop[closing] = True
    # spans of values
    keep = ~sep & ~border
    begin = keep & ~np.append(False, keep[:-1] & (row[:-1] == row[1:]))
    label = np.cumsum(begin) - 1
    real = np.flatnonzero(keep & ~drop & ~(blank & ~escaped))
    if not len(real):
        return pa.array([[] for _ in range(len(ends))], pa.large_list(pa.string()))
    owner = label[real]
    change = np.append(True, owner[1:] != owner[:-1])
    first = real[change]
    last = real[np.append(change[1:], True)]
    at = ranges(first, last - first + 1)
    stay = ~drop[at]
    sizes = np.add.reduceat(stay.astype(np.int64), np.append(0, np.cumsum(last - first + 1)[:-1]))
    out = chars[at[stay]].tobytes().decode("utf-32-le").encode("utf-8")
    raw = np.frombuffer(out, np.uint8)
    byte_at = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw)).astype(np.int64)
    cuts = byte_at[np.append(0, np.cumsum(sizes))]
    values = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(cuts), pa.py_buffer(raw))
    return pa.LargeListArray.from_arrays(pa.array(np.searchsorted(row[first], np.arange(len(ends) + 1)), pa.int64()), values.cast(pa.string()))


def split_packed(df: DataFrame, terms: DataFrame, id_col: str = "rec_id", field: str = "cuisine", term_col: str = "term", out: str = "cuisine_value") -> DataFrame:
    """``(id_col, pos INT, out STRING)``: one row per value of ``field``, ``pos`` from 0; ``terms`` are kept whole."""
    known = [r[0] for r in terms.select(term_col).filter(f"{term_col} is not null").distinct().limit(MOST_TERMS + 1).collect()]
    if len(known) > MOST_TERMS:
        raise ValueError(f"over {MOST_TERMS} terms; they are a list of names, not data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = term_pattern(known)
        for batch in batches:
            text = string_column(batch.column(1))
            for a, b in slices(np.diff(raw_bytes(text)[1]), SLICE_BYTES):
                lists = value_lists(text.slice(a, b - a), pattern)
                parent = pc.list_parent_indices(lists).to_numpy()
                offsets = lists.offsets.to_numpy()
                pos = np.arange(len(parent)) - offsets[parent]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(parent + a)), pa.array(pos, pa.int32()), lists.flatten()], ["id", "pos", "value"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(id_col, field).filter(f"{field} is not null")
    return rows.mapInArrow(run, f"id {kind}, pos int, value string").withColumnsRenamed({"id": id_col, "value": out})
