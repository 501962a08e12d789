import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from veldra.functions.buffers import code_points, string_column
from veldra.llm import splitting


def plain(t, limit, overlap, least):
    s, n, out = 0, 0, []
    while len(t) - s > limit:
        e = s + limit
        for pattern in (r"\n\r?\n", r"\n", r"[.!?][ \t]|[。！？]", r"[ \t]"):
            hits = [c for c in range(s + limit, s + least - 1, -1) if any(re.fullmatch(pattern, t[c - k : c]) for k in (1, 2, 3))]
            if hits:
                e = hits[0]
                break
        out.append((n, s, e))
        s, n = e - overlap, n + 1
    return [*out, (n, s, len(t))]


TEXT = st.text(alphabet="ab. \n\r\t!?。é", max_size=150)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, max_size=5))
def test_forward(texts):
    chars, rows, _, _ = code_points(string_column(pa.array(texts, pa.string())))
    got = splitting.forward_pieces(rows, splitting.boundaries(chars, rows), 20, 4, 9)
    want = [(i, *p) for i, t in enumerate(texts) if len(t) > 20 for p in plain(t, 20, 4, 9)]
    assert sorted(zip(*(x.tolist() for x in got))) == want


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, max_size=5))
def test_bisect(texts):
    chars, rows, _, _ = code_points(string_column(pa.array(texts, pa.string())))
    at, number, start, end = splitting.bisected_pieces(rows, splitting.boundaries(chars, rows), 20, 4)
    for i, t in enumerate(texts):
        mine = np.flatnonzero(at == i)
        assert bool(len(mine)) == bool(t)
        if t:
            assert number[mine].tolist() == list(range(len(mine))) and start[mine[0]] == 0 and end[mine[-1]] == len(t)
            assert (end[mine] - start[mine] <= 20).all() and (start[mine][1:] == end[mine][:-1] - 4).all()


def test_operator(spark):
    long = "One sentence here. " * 200
    rows = [(1, long, "x"), (1, long, "x"), (2, None, "x"), (3, "", "x"), (4, "short", None), (None, "w" * 100_000, "x")]
    df = spark.createDataFrame(rows, "row_id bigint, text string, piece_no string")
    got = splitting.split_forward(df).collect()
    assert sorted((r["piece_no"], r["char_start"], r["char_end"]) for r in got if r["row_id"] == 1) == sorted(plain(long, 512, 50, 257) * 2)
    assert {r["row_id"] for r in got} == {1, None}
    assert {r["row_id"] for r in splitting.split_bisect(df).collect()} == {1, 4, None}
    assert splitting.split_forward(df.limit(0)).count() == 0
