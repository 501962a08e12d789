import random
import re

import pytest

from veldra.llm import similar


def sets(texts, words):
    out = []
    for t in texts:
        w = re.findall("[a-z0-9]+", (t or "").lower())
        out.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)})
    return out


def corpus(seed, n=160):
    rng = random.Random(seed)
    common = [f"c{i}" for i in range(30)]
    rows, texts = [], []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.5:
            w = rng.choice(texts).split()
            for _ in range(rng.randint(0, 4)):
                i = rng.randrange(len(w))
                w[i : i + rng.randint(0, 1)] = [rng.choice(["new", "Été", "x1"])] * rng.randint(0, 2)
                w = w or ["a"]
        elif kind < 0.8:
            w = common[:20] + [f"r{rng.randrange(60)}" for _ in range(rng.randint(3, 25))]
        else:
            w = [f"w{rng.randrange(300)}" for _ in range(rng.randint(1, 40))]
        texts.append(" ".join(w))
    for i, t in enumerate(texts):
        rows.append((i, f"d{rng.randrange(40)}", t, "x"))
    return rows + [(9000, None, texts[0], "x"), (9001, "d1", None, "x"), (9002, "d2", "", "x"), (9003, "d3", "two words", "x"), (None, "d4", texts[0], "x")]


def brute(rows, words, t):
    s = sets([r[2] for r in rows], words)
    out = set()
    for i in range(len(rows)):
        for j in range(i + 1, len(rows)):
            a, b = rows[i], rows[j]
            if None not in (a[0], b[0], a[1], b[1]) and a[1] != b[1] and s[i] and s[j] and len(s[i] & s[j]) >= t * len(s[i] | s[j]):
                out.add((min(a[0], b[0]), max(a[0], b[0])))
    return out


@pytest.mark.parametrize("seed,words,t", [(1, 3, 0.6), (2, 5, 0.8), (3, 3, 0.5)])
def test_all_pairs(spark, seed, words, t):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "row_id bigint, doc_id string, text string, id string")
    got = [tuple(r) for r in similar.similar_pairs(spark, df, words=words, t=t).collect()]
    want = brute(rows, words, t)
    assert want and len(got) == len(set(got)) and set(got) == want


def test_hot_shingles(spark, monkeypatch):
    """Shingles over the block size are joined in blocks with the same result."""
    monkeypatch.setattr(similar, "BLOCK", 15)
    monkeypatch.setattr(similar, "CHUNK", 50)
    rows = corpus(5)
    df = spark.createDataFrame(rows, "row_id bigint, doc_id string, text string, id string")
    assert {tuple(r) for r in similar.similar_pairs(spark, df, words=3, t=0.6).collect()} == brute(rows, 3, 0.6)


def test_large_class(spark, monkeypatch):
    """Copies beyond the bound are linked to their class and to similar ones, not multiplied out."""
    monkeypatch.setattr(similar, "MEMBERS", 3)
    base = " ".join(f"w{i}" for i in range(40))
    rows = [(i, f"d{i % 5}", base, "x") for i in range(30)] + [(100, "e", base + " tail", "x")]
    df = spark.createDataFrame(rows, "row_id bigint, doc_id string, text string, id string")
    got = {tuple(r) for r in similar.similar_pairs(spark, df, words=3, t=0.6).collect()}
    assert got <= brute(rows, 3, 0.6)
    assert all(any(i in p for p in got) for i, *_ in rows)
    assert {i for i in range(30)} <= {a for a, b in got if b == 100}


@pytest.mark.parametrize("tail", ["d0", "e"])
def test_large_class_of_one_group(spark, monkeypatch, tail):
    """A hot group that holds the lowest ids of a class: each record with a true pair is in a row."""
    monkeypatch.setattr(similar, "MEMBERS", 3)
    base = " ".join(f"w{i}" for i in range(40))
    rows = [(i, "d0" if i < 12 or i % 3 else f"d{i % 4 + 1}", base, "x") for i in range(30)] + [(100 + i, tail, base + " tail", "x") for i in range(8)]
    df = spark.createDataFrame(rows, "row_id bigint, doc_id string, text string, id string")
    got = [tuple(r) for r in similar.similar_pairs(spark, df, words=3, t=0.6).collect()]
    want = brute(rows, 3, 0.6)
    assert len(got) == len(set(got)) and set(got) <= want
    assert {i for p in got for i in p} == {i for p in want for i in p} == {r[0] for r in rows}
    # towards the similar class too, for each record beyond the kept ones
    apart = lambda pairs: {i for a, b in pairs if a < 100 <= b for i in (a, b)}
    assert apart(got) == apart(want)


def links(rows, words, t):
    """Class and number of links of each record by comparing all."""
    s = sets([r[2] for r in rows], words)
    kept = [(r[0], r[1], x) for r, x in zip(rows, s) if None not in (r[0], r[1]) and x]
    return {(i, min(k for k, _, y in kept if y == x), sum(g != h and len(x & y) >= t * len(x | y) for _, h, y in kept)) for i, g, x in kept}


def class_pairs(rows, words, t):
    s = sets([r[2] for r in rows], words)
    low = {}
    for r, x in zip(rows, s):
        if None not in (r[0], r[1]) and x:
            low[frozenset(x)] = min(r[0], low.get(frozenset(x), r[0]))
    return {(a, b) for x, a in low.items() for y, b in low.items() if a < b and len(x & y) >= t * len(x | y)}


BASE = " ".join(f"w{i}" for i in range(40))
HOT = {
    "one document": [(i, "d0", BASE, "x") for i in range(60)] + [(60, "d1", BASE, "x")],
    "two classes": [(i, f"d{i % 7}", BASE, "x") for i in range(50)] + [(50 + i, f"d{i % 11}", BASE + " tail", "x") for i in range(45)] + [(200, "d3", BASE + " tail end", "x")],
    "mixed": corpus(7),
}


@pytest.mark.parametrize("name", HOT)
def test_links_and_classes(spark, name):
    rows = HOT[name]
    df = spark.createDataFrame(rows, "row_id bigint, doc_id string, text string, class_id string").repartition(3)
    got = [tuple(r) for r in similar.similar_links(spark, df, words=3, t=0.6).collect()]
    assert len(got) == len(set(got)) and set(got) == links(rows, 3, 0.6)
    got = [tuple(r) for r in similar.similar_classes(spark, df, words=3, t=0.6).collect()]
    assert len(got) == len(set(got)) and set(got) == class_pairs(rows, 3, 0.6)


@pytest.mark.parametrize("name", HOT)
def test_every_pair_without_the_bound(spark, name):
    rows = HOT[name]
    df = spark.createDataFrame(rows, "row_id bigint, doc_id string, text string, class_id string")
    got = [tuple(r) for r in similar.similar_pairs(spark, df, words=3, t=0.6, members=None).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 3, 0.6)


@pytest.mark.parametrize("held,tasks,part", [(1, 2, 60), (10**6, 3, 10)])
def test_parts_and_packets(spark, monkeypatch, held, tasks, part):
    """Many small packets, or more parts than tasks, change nothing."""
    monkeypatch.setattr(similar, "HELD", held)
    monkeypatch.setattr(similar, "MOST_TASKS", tasks)
    monkeypatch.setattr(similar, "PART_KEYS", part)
    rows = corpus(8)
    df = spark.createDataFrame(rows, "row_id bigint, doc_id string, text string, id string")
    assert {tuple(r) for r in similar.similar_pairs(spark, df, words=3, t=0.6).collect()} == brute(rows, 3, 0.6)


def test_common_shingles(spark):
    """The counts of the sample are those of counting all records, the most frequent kept."""
    rows = corpus(9)
    df = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] is not None], "id bigint, text string").repartition(4)
    s, n = similar._sample_counts(df, len(rows), 3)
    seen = {}
    for x in sets([r[2] for r in rows if r[0] is not None], 3):
        for g in x:
            seen[g] = seen.get(g, 0) + 1
    assert (s[1:] > s[:-1]).all() and sorted(n.tolist()) == sorted(k for k in seen.values() if k > 1)


def test_empty(spark):
    df = spark.createDataFrame([], "row_id bigint, doc_id string, text string")
    assert similar.similar_pairs(spark, df).count() == similar.similar_links(spark, df).count() == similar.similar_classes(spark, df).count() == 0
