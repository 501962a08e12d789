import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veldra.functions import vec
from veldra.functions.graph import Graph
from veldra.operators import hnsw, indexes, ivf, knn


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(42)
    centres = rng.standard_normal((40, 32))
    v = centres[rng.integers(0, 40, 3000)] + 0.6 * rng.standard_normal((3000, 32))
    v = (v / np.linalg.norm(v, axis=1)[:, None]).astype(np.float32)
    rows = [(i, x.tolist(), int(i % 7)) for i, x in enumerate(v)] + [(9000, None, 1), (9001, [1.0], 1)]
    return v, spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").cache()


def asked(df):
    return df.filter("vec_id % 100 = 0 and vec_id < 3000").withColumnRenamed("vec_id", "query_id")


def table(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["query_id"], {})[r["rank"]] = r["id"]
    return {q: [ids[i] for i in sorted(ids)] for q, ids in out.items()}


def brute(v, keep=lambda q, i: True):
    v = v.astype(np.float64)
    return {q: [i for i in np.argsort(-(v @ v[q]), kind="stable") if keep(q, i)][:10] for q in range(0, 3000, 100)}


@pytest.mark.parametrize("block", [100_000, 700])
def test_exact(data, block):
    v, df = data
    assert table(knn.search(asked(df), df, 10, 32, block_rows=block)) == brute(v)


def test_filters(data):
    v, df = data
    assert table(knn.search(asked(df), df, 10, 32, same="label")) == brute(v, lambda q, i: q % 7 == i % 7)
    assert table(knn.search(asked(df), df, 10, 32, differ="label")) == brute(v, lambda q, i: q % 7 != i % 7)


def test_empty(data):
    _, df = data
    assert knn.search(asked(df).limit(0), df, 10, 32).count() == 0
    assert hnsw.search(asked(df), df.limit(0), 10, 32).count() == 0


def recall(found, want):
    return np.mean([len(set(found.get(q, [])) & set(want[q])) / 10 for q in want])


def test_ivf_recall(data):
    v, df = data
    centroids = ivf.fit(df.filter("size(embedding) = 32"), 40, 8)
    assert recall(table(ivf.search(asked(df), df, centroids, 10, 8)), brute(v)) >= 0.8


@pytest.mark.parametrize("shard", [16_000, 800])
def test_hnsw_recall(data, shard):
    v, df = data
    assert recall(table(hnsw.search(asked(df), df, 10, 32, shard_rows=shard)), brute(v)) >= 0.9


def test_edges(data):
    _, df = data
    centroids = ivf.train(df, 3, 5)
    nodes = hnsw.build(df, centroids, 32, shard_rows=600)
    assert nodes.select("shard", "part").distinct().count() >= 3 and nodes.count() == 3000
    e = hnsw.edges(nodes)
    assert e.filter("src = dst").count() == 0
    assert e.filter("layer = 0").select("src").distinct().count() == 3000


@pytest.mark.parametrize("exact", [2048, 64])
def test_node_rows_hold_the_graph(exact):
    """A graph comes back from its rows as it was."""
    rng = np.random.default_rng(5)
    ids, v = np.arange(900) * 7, rng.standard_normal((900, 8)).astype(np.float32)
    graph = Graph(ids, v, exact=exact)
    rows = pa.Table.from_batches(hnsw._rows((2, 1), graph))
    back = hnsw._graph([rows["id"].to_numpy()], [hnsw._floats(rows["vec"], 8)], rows["links"].to_pylist())
    assert (back.ids == graph.ids).all() and (back.v == graph.v).all() and back.sizes == graph.sizes
    assert all((a == b).all() for a, b in zip(back.layers, graph.layers))
    assert all((a == b).all() for a, b in zip(back.search(v[:50], 5), graph.search(v[:50], 5)))


@pytest.mark.parametrize("kind,params", [("exact", {}), ("ivf", {"lists": 40}), ("ivf", {"lists": 3, "probes": 3}), ("hnsw", {}), ("hnsw", {"shard_rows": 500, "probes": 6, "margin": 2.0})])
def test_stored_index(spark, data, tmp_path, kind, params):
    """Built of two thirds, loaded, appended to, searched, with and without rows left out."""
    v, df = data
    rows = df.select(F.col("vec_id").alias("id"), "embedding", F.lit("x").alias("vec"))
    path = str(tmp_path / "index")
    with pytest.raises(indexes.NotBuilt):
        indexes.load(spark, path)
    indexes.build(kind, rows.filter("id % 3 > 0"), path, 32, **params)
    index = indexes.load(spark, path)
    assert index.kind == kind and index.count() == 2000
    index.add(rows.filter("id % 3 = 0"))
    index = indexes.load(spark, path)
    assert index.count() == 3000
    found = table(index.search(asked(df), 10))
    assert recall(found, brute(v)) >= (1.0 if kind == "exact" else 0.9)
    gone = rows.filter("id % 5 = 0").select("id")
    found = table(index.search(asked(df), 10, exclude=gone))
    assert not any(i % 5 == 0 for ids in found.values() for i in ids) and recall(found, brute(v, lambda q, i: i % 5 > 0)) >= 0.85


@pytest.mark.parametrize("kind", ["exact", "ivf", "hnsw"])
def test_empty_index(spark, data, tmp_path, kind):
    v, df = data
    rows = df.select(F.col("vec_id").alias("id"), "embedding")
    index = indexes.build(kind, rows.limit(0), str(tmp_path / "i"), 32)
    assert index.count() == 0 and index.search(asked(df), 3).count() == 0
    index = indexes.load(spark, str(tmp_path / "i")).add(rows.filter("id < 50 or id >= 9000"))
    assert index.count() == 50 and index.search(asked(df), 3).count() == 90


def test_own_index(spark, data, tmp_path):
    """A caller's kind of index is registered, built and loaded by its name."""

    @indexes.register("first")
    class First(indexes.Exact):
        def search(self, queries, k, exclude=None, **over):
            return super().search(queries, 1, exclude)

    try:
        rows = data[1].select(F.col("vec_id").alias("id"), "embedding")
        indexes.build("first", rows, str(tmp_path / "i"), 32)
        assert indexes.load(spark, str(tmp_path / "i")).search(asked(data[1]), 10).count() == 30
        with pytest.raises(ValueError):
            indexes.build("other", rows, str(tmp_path / "j"), 32)
        with pytest.raises(ValueError):
            indexes.build("ivf", rows, str(tmp_path / "j"), 32, wrong=1)
    finally:
        del indexes.KINDS["first"]


def test_long_lists(data):
    """Lists over the block size are cut, with the same result; positions in lists are counted over spans."""
    v, df = data
    good = df.filter("size(embedding) = 32")
    centroids = ivf.fit(good, 4, 3)
    lists = ivf.listed(good, centroids)
    whole, cut = (table(ivf.search_lists(asked(df), lists, centroids, 10, 2, list_rows=n)) for n in (100_000, 150))
    assert whole == cut
    rows = ivf.postings(ivf.assign(good, centroids)).collect()
    lists = {}
    for r in rows:
        lists.setdefault(r["cid"], []).append((r["vec_id"], r["pos"]))
    assert all([p for _, p in sorted(x)] == list(range(len(x))) for x in lists.values()) and len(rows) == 3000


def test_arithmetic(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0]), ([1.0, float("nan")], [1.0, 2.0])], "a array<float>, b array<float>")
    r = df.select(vec.norm(F.col("a")).alias("n"), vec.normalize(F.col("a")).alias("u"), vec.normalize(F.col("b")).alias("z"), vec.cosine(F.col("a"), F.col("b")).alias("c"), vec.l2_squared(F.col("a"), F.col("b")).alias("d"), vec.usable(F.col("a"), 2).alias("ok"), vec.usable(F.col("b"), 2).alias("zero")).collect()
    assert (r[0]["n"], r[0]["u"], r[0]["z"], r[0]["c"], r[0]["d"], r[0]["ok"], r[0]["zero"]) == (5.0, [0.6, 0.8], [0.0, 0.0], 0.0, 25.0, True, False)
    assert not r[1]["ok"] and r[1]["zero"]


def test_too_many_centroids(data):
    with pytest.raises(ValueError):
        ivf.initial(data[1], 5000)
