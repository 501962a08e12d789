import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veldra.llm import packing


def check(histogram, patterns, capacity):
    used = {}
    for items, times in patterns:
        assert times > 0 and sum(s * k for s, k in items) <= capacity
        for s, k in items:
            used[s] = used.get(s, 0) + k * times
    assert used == {s: n for s, n in histogram.items() if s and n}


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.integers(1, 24), st.integers(1, 30), max_size=24))
def test_plan_holds_every_item(histogram):
    patterns, fixed = packing.plan_containers(histogram, 24)
    check(histogram, patterns, 24)
    assert 0 <= fixed <= len(patterns)


def least(items, capacity):
    """Fewest containers by trying all."""
    best = len(items)

    def go(rest, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if not rest:
            best = len(rooms)
            return
        for i in range(len(rooms)):
            if rooms[i] >= rest[0] and rooms.index(rooms[i]) == i:
                go(rest[1:], [*rooms[:i], rooms[i] - rest[0], *rooms[i + 1 :]])
        go(rest[1:], [*rooms, capacity - rest[0]])

    go(sorted(items, reverse=True), [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=8))
def test_reduction_loses_nothing(items):
    """Containers fixed by dominance, and the best packing of the rest, are together as few as the best packing of all."""
    counts = np.bincount(items, minlength=13).astype(np.int64)
    fixed = packing.reduce_instance(counts, 12)
    rest = [s for s in range(1, 13) for _ in range(int(counts[s]))]
    assert sum(t for _, t in fixed) + (least(rest, 12) if rest else 0) == least(items, 12)


def test_pairs():
    rng = random.Random(2)
    for _ in range(200):
        sizes = sorted(rng.sample(range(1, 60), rng.randint(1, 20)))
        room = rng.randint(1, 130)
        assert packing.largest_pair(np.array(sizes), room) == max((a + b for a in sizes for b in sizes if a + b <= room), default=0)
    assert packing.largest_pair(np.zeros(0, np.int64), 5) == 0


def test_many_sizes():
    """The rule for two more items holds for instances of over 512 sizes as for small ones."""
    rng = random.Random(6)
    histogram = {s: rng.randint(1, 3) for s in rng.sample(range(600, 2049), 900)}
    counts = np.zeros(2049, np.int64)
    for s, n in histogram.items():
        counts[s] = n
    fixed = packing.reduce_instance(counts, 2048)
    assert sum(len(items) == 2 for items, _ in fixed) > 100
    check(histogram, packing.plan_containers(histogram, 2048)[0], 2048)


@pytest.mark.parametrize("rows", [7, 100_000])
def test_salts(spark, monkeypatch, rows):
    """A size of most rows is spread over salts; each container stays within the capacity."""
    monkeypatch.setattr(packing, "SALT_ROWS", rows)
    df = spark.createDataFrame([(i, 40 if i % 3 else 100) for i in range(600)], "doc_id bigint, n_tokens bigint")
    got = packing.pack_sizes(df, capacity=100).toPandas()
    load = (got.token_end - got.token_start).groupby(got.container_id).sum()
    assert len(got) == 600 and load.max() <= 100 and len(load) == 400


def test_operator(spark):
    rng = random.Random(3)
    sizes = [int(rng.lognormvariate(3, 1)) for _ in range(3000)] + [40] * 1500 + [0, 250, 100]
    rows = [(i, n, "x") for i, n in enumerate(sizes)] + [(7, 5, "x"), (8000, None, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint, container_id string")
    got = packing.pack_sizes(df, capacity=100).toPandas()
    got["n"] = got.token_end - got.token_start
    by_doc = got.groupby("doc_id").n.sum()
    assert all(by_doc[i] == n for i, n in enumerate(sizes) if i != 7) and by_doc[8000] == 0
    load = got.groupby("container_id").n.sum()
    assert load.max() <= 100 and sorted(load.index) == list(range(len(load)))
    assert len(load) <= 1.01 * got.n.sum() / 100 + 1
    assert (got[got.piece_no > 0].groupby("doc_id").size() > 0).all() and set(got[got.piece_no > 0].doc_id) <= {i for i, n in enumerate(sizes) if n > 100}
    assert (got[got.doc_id == 3000 + 1500 + 1].n.tolist()) in ([100, 100, 50], [50, 100, 100], [100, 50, 100])


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, n_tokens bigint")
    assert packing.pack_sizes(df).count() == 0
    nothing = spark.createDataFrame([(1, 0), (2, None)], "doc_id bigint, n_tokens bigint")
    assert [r["container_id"] for r in packing.pack_sizes(nothing).collect()] == [0, 0]


def test_texts(spark):
    pytest.importorskip("tokenizers")
    df = spark.createDataFrame([(1, "word " * 3000), (2, "x"), (3, None), (4, "")], "doc_id bigint, text string")
    got = packing.pack_texts(spark, df).collect()
    assert sorted((r["doc_id"], r["piece_no"]) for r in got) == [(1, 0), (1, 1), (2, 0), (3, 0), (4, 0)]
