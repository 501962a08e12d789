"""Queries over vectors: arithmetic, exact search, inverted file, graph index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veldra.functions import vec
from veldra.functions.graph import levels_of
from veldra.operators import hnsw, indexes, ivf, knn
from veldra.runtime import materialize, read_table, scratch_path

DIM, K, LISTS, PROBES = 64, 10, 16, 12


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "embeddings")


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 20."""
    return _vectors(spark, d).filter(F.col("vec_id") % 20 == 0).withColumnRenamed("vec_id", "query_id")


def _successors(spark: SparkSession, d: str) -> DataFrame:
    a = _vectors(spark, d)
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("next_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id")


def _pairs(spark: SparkSession, d: str, name: str, value) -> DataFrame:
    return _successors(spark, d).select("vec_id", "next_id", F.round(value(F.col("embedding"), F.col("other")), 6).alias(name))


def dot_products(spark, d):
    return _pairs(spark, d, "dot", vec.dot)


def l2_distance(spark, d):
    return _pairs(spark, d, "l2", vec.l2_squared)


def cosine_unnormalized(spark, d):
    """Cosine of vectors made of unequal length; zero where one has no length."""
    long = lambda a, i: F.transform(a, lambda x: x.cast("double") * (i % 5))
    rows = _successors(spark, d)
    value = vec.cosine(long(F.col("embedding"), F.col("vec_id")), long(F.col("other"), F.col("next_id")))
    return rows.select("vec_id", "next_id", F.round(value, 6).alias("cosine"))


def vector_norms(spark, d):
    return _vectors(spark, d).select("vec_id", F.round(vec.norm(F.col("embedding")), 6).alias("norm"))


def normalize(spark, d):
    rows = _vectors(spark, d).select("vec_id", F.posexplode(vec.normalize(F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") % 3)))).alias("pos", "x"))
    return rows.select("vec_id", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


def vector_scan_stats(spark, d):
    size = F.size("embedding")
    return read_table(spark, d, "vector_store").agg(
        F.count("*").alias("n"), F.count_if(vec.usable(F.col("embedding"), 128)).alias("usable"), F.count_if(F.col("embedding").isNull()).alias("nulls"),
        F.min(F.when(F.col("embedding").isNotNull(), size)).cast("long").alias("min_dim"), F.max(F.when(F.col("embedding").isNotNull(), size)).cast("long").alias("max_dim"),
    )


def vector_lookup(spark, d):
    """Vectors looked up by the row numbers of a key table: those of chunks that begin a document."""
    keys = read_table(spark, d, "chunks").filter("chunk_id = 0").select("row_id")
    return read_table(spark, d, "vector_store").join(keys, "row_id", "left_semi").select("row_id", "doc_row", "chunk_offset", F.when(~F.isnan("norm"), F.round(F.col("norm").cast("double"), 5)).alias("norm"))


def mean_pool(spark, d):
    rows = _vectors(spark, d).select("label", F.posexplode("embedding").alias("pos", "x"))
    return rows.groupBy("label", F.col("pos").cast("long").alias("pos")).agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


def masked_pool(spark, d):
    """Masked mean of each four vectors that follow one another, every third vector masked out."""
    rows = _vectors(spark, d).groupBy(F.floor(F.col("vec_id") / 4).alias("four")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("some"))  # four at most
    rows = rows.select("four", F.transform("some", lambda x: x["embedding"]).alias("v"), F.transform("some", lambda x: (x["vec_id"] % 3 > 0).cast("int")).alias("m"))
    return rows.select("four", F.posexplode(vec.masked_mean(F.col("v"), F.col("m"))).alias("pos", "x")).select("four", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


def _ranked(df: DataFrame) -> DataFrame:
    return df.select("query_id", F.col("rank").cast("long").alias("rank"), F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


def knn_exact(spark, d):
    return _ranked(knn.search(_asked(spark, d), _vectors(spark, d), K, DIM))


def knn_batch(spark, d):
    """Neighbours other than the query itself, with unequal lengths: cosine, the filter before the top k."""
    long = lambda c: F.transform("embedding", lambda x: x.cast("double") * (1 + F.col(c) % 7))
    queries = _asked(spark, d).withColumn("tag", F.col("query_id")).select("query_id", long("query_id").alias("embedding"), "tag")
    vectors = _vectors(spark, d).select("vec_id", long("vec_id").alias("embedding"), F.col("vec_id").alias("tag"))
    return _ranked(knn.search(queries, vectors, K, DIM, normalized=False, differ="tag"))


def knn_filtered(spark, d):
    return _ranked(knn.search(_asked(spark, d), _vectors(spark, d), K, DIM, same="label"))


def knn_exclude(spark, d):
    return _ranked(knn.search(_asked(spark, d), _vectors(spark, d), K, DIM, differ="label"))


def multi_query(spark, d):
    """Several queries of one group merged: the best score of each vector over the queries of a label, ten a label."""
    found = knn.search(_asked(spark, d), _vectors(spark, d), K, DIM)
    groups = _asked(spark, d).select("query_id", F.col("label").alias("topic"))
    best = found.join(groups, "query_id").groupBy("topic", "id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("topic").orderBy(F.desc(F.round("score", 6)), "id")
    ranked = best.withColumn("rank", (F.row_number().over(w) - 1).cast("bigint")).filter(F.col("rank") < K)
    return ranked.select("topic", "rank", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


def knn_graph(spark, d):
    """Edges from every query vector to its eight closest others; an edge is mutual if its end has the query among its own eight, which are searched for all ends."""
    tagged = _vectors(spark, d).withColumn("tag", F.col("vec_id"))
    near = lambda asked: knn.search(asked.withColumnRenamed("vec_id", "query_id"), tagged, 8, DIM, differ="tag").select(F.col("query_id").alias("src"), F.col("id").alias("dst"))
    edges = materialize(near(tagged.filter("vec_id % 20 = 0")), "edges")
    ends = near(tagged.join(edges.select(F.col("dst").alias("vec_id")).distinct(), "vec_id", "left_semi"))
    back = ends.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(True).alias("mutual"))
    return edges.join(back, ["src", "dst"], "left").select("src", "dst", F.coalesce("mutual", F.lit(False)).alias("mutual"))


def _exact_ids(spark, d) -> DataFrame:
    return knn.search(_asked(spark, d), _vectors(spark, d), K, DIM).select("query_id", "id")


def _first(spark, d):
    return ivf.initial(_vectors(spark, d), LISTS)


def _trained(spark, d):
    """Centroids after three Lloyd rounds."""
    return ivf.fit(_vectors(spark, d), LISTS, 3, 0.0)


def ivf_assign(spark, d):
    return ivf.assign(_vectors(spark, d), _trained(spark, d)).select("vec_id", F.col("cid").cast("long").alias("cid"))


def ivf_postings(spark, d):
    rows = ivf.postings(materialize(ivf.assign(_vectors(spark, d), _trained(spark, d)), "assigned"))
    return rows.select(F.col("cid").cast("long").alias("cid"), F.col("pos").cast("long").alias("pos"), "vec_id")


def ivf_list_sizes(spark, d):
    """Number, least, greatest and mean size of the lists, empty ones included."""
    sizes = ivf.assign(_vectors(spark, d), _trained(spark, d)).groupBy("cid").count()
    every = spark.range(LISTS).select(F.col("id").cast("int").alias("cid")).join(sizes, "cid", "left").select(F.coalesce("count", F.lit(0)).alias("n"))
    return every.agg(F.count("*").alias("lists"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"), F.sum("n").alias("total"))


def _table(spark, centroids) -> DataFrame:
    rows = [(i, j, round(float(x), 6) + 0.0) for i, row in enumerate(centroids) for j, x in enumerate(row)]
    return spark.createDataFrame(rows, "cid bigint, pos bigint, x double")


def kmeans_step(spark, d):
    return _table(spark, ivf.lloyd_round(_vectors(spark, d), _first(spark, d)))


def kmeans_3(spark, d):
    centroids = _first(spark, d)
    for _ in range(3):
        centroids = ivf.lloyd_round(_vectors(spark, d), centroids)
    return _table(spark, centroids)


def kmeans_shift(spark, d):
    before = _first(spark, d)
    after = ivf.lloyd_round(_vectors(spark, d), before)
    return spark.createDataFrame([(round(float(((after - before) ** 2).sum() ** 0.5), 6),)], "shift double")


def ivf_probe(spark, d):
    return ivf.probe(_asked(spark, d), _trained(spark, d), PROBES).select("query_id", F.col("rank").cast("long").alias("rank"), F.col("cid").cast("long").alias("cid"), F.round("score", 6).alias("score"))


def ivf_search(spark, d):
    return _ranked(ivf.search(_asked(spark, d), _vectors(spark, d), _trained(spark, d), K, PROBES))


def _plain(df: DataFrame) -> DataFrame:
    return df.select(F.col("vec_id").alias("id"), "embedding")


def _stored(spark, vectors: DataFrame, kind: str, dim: int = DIM, **params) -> indexes.Index:
    """An index built, and loaded from where it was written."""
    path = scratch_path(spark, kind)
    indexes.build(kind, vectors, path, dim, **params)
    return indexes.load(spark, path)


def _lists(index: indexes.Index) -> DataFrame:
    lists = index.lists().groupBy("cid").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))
    heads = index._table("centroids", index.CENTROIDS).select("cid", F.round(F.get("centroid", F.lit(0)), 6).alias("head"), F.round(F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))
    return heads.join(lists, "cid").select(F.col("cid").cast("long").alias("cid"), "n", "ids", "head", "total")


def ivf_roundtrip(spark, d):
    """An index written and read back has the lists and centroids it was made of."""
    return _lists(_stored(spark, _plain(_vectors(spark, d)), "ivf", lists=LISTS, probes=PROBES, rounds=3, sample=10**9))


def ivf_add(spark, d):
    """Vectors appended to a stored index of the others go to the lists of its centroids."""
    rows = _vectors(spark, d)
    index = _stored(spark, _plain(rows.filter("vec_id % 2 = 0")), "ivf", lists=LISTS, probes=PROBES, rounds=0, sample=10**9)
    return _lists(index.add(_plain(rows.filter("vec_id % 2 = 1"))))


def index_add(spark, d):
    """A stored exact index, appended to, finds among all vectors."""
    rows = _vectors(spark, d)
    index = _stored(spark, _plain(rows.filter("vec_id % 3 = 0")), "exact").add(_plain(rows.filter("vec_id % 3 > 0")))
    return _ranked(index.search(_asked(spark, d), K))


def hnsw_roundtrip(spark, d):
    """Vectors of a stored graph index, half of them appended, as they come out of the node table, with their links counted as none lost."""
    rows = _vectors(spark, d)
    index = _stored(spark, _plain(rows.filter("vec_id % 2 = 0")), "hnsw").add(_plain(rows.filter("vec_id % 2 = 1")))
    linked = hnsw.edges(index.nodes()).filter("layer = 0").select(F.col("src").alias("id")).distinct().withColumn("linked", F.lit(True))
    heads = index.nodes().join(linked, "id", "left").select(F.col("id").alias("vec_id"), F.length("vec").cast("long").alias("bytes"), F.coalesce("linked", F.lit(False)).alias("linked"))
    return heads


def _recall(exact: DataFrame, found: DataFrame) -> DataFrame:
    hits = exact.join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left").groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall"))
    return hits.agg(F.count("*").alias("queries"), F.avg("recall").alias("recall"))


def index_figures(spark, d) -> list[tuple]:
    """Of each approximate kind over the usable vectors of the store: kind, queries, recall of the exact ten, share of vectors scored (null for graphs)."""
    rows = read_table(spark, d, "vector_store").filter(vec.usable(F.col("embedding"), 128)).select(F.col("row_id").alias("id"), vec.normalize(F.col("embedding")).cast("array<float>").alias("embedding"))
    rows = materialize(rows, "usable")
    asked = rows.filter("id % 20 = 0").withColumnRenamed("id", "query_id")
    exact = materialize(knn.search(asked, rows, K, 128, id_col="id"), "exact")
    out = []
    for kind in ("ivf", "hnsw"):
        index = _stored(spark, rows, kind, 128, **({"near": K} if kind == "ivf" else {}))
        r = _recall(exact, index.search(asked, K)).first()
        scanned = None
        if kind == "ivf":
            centroids = index.centroids()
            probed = ivf.probe(asked, centroids, index.params["probes"]).select("cid").join(index._table("sizes", "cid int, count bigint"), "cid")
            scanned = probed.agg(F.sum("count")).first()[0] / max(r["queries"] * rows.count(), 1)
        out.append((kind, r["queries"], r["recall"], scanned))
    return out


def index_recall(spark, d):
    """Whether each stored approximate index finds nine of ten exact neighbours, the inverted file in a quarter of the vectors."""
    return spark.createDataFrame([(kind, n, recall >= 0.9, scanned is None or scanned <= 0.25) for kind, n, recall, scanned in index_figures(spark, d)], "kind string, queries bigint, found boolean, selective boolean")


def recall_at_k(spark, d):
    """Mean share of the exact ten that the inverted file finds."""
    found = ivf.search(_asked(spark, d), _vectors(spark, d), _trained(spark, d), K, PROBES)
    return _recall(_exact_ids(spark, d), found).select("queries", F.round("recall", 6).alias("recall"))


def missed_neighbours(spark, d):
    """The exact ten less those that the inverted file finds."""
    found = ivf.search(_asked(spark, d), _vectors(spark, d), _trained(spark, d), K, PROBES).select("query_id", "id")
    return _exact_ids(spark, d).join(found, ["query_id", "id"], "left_anti").select("query_id", F.col("id").alias("vec_id"))


def hnsw_levels(spark, d):
    """Level of each node by the law of the graphs."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(levels_of(batch.column(0).to_numpy()), pa.int64())], ["vec_id", "level"])

    return _vectors(spark, d).select("vec_id").mapInArrow(run, "vec_id bigint, level bigint")


def hnsw_search(spark, d):
    return _ranked(_stored(spark, _plain(_vectors(spark, d)), "hnsw", exact=256).search(_asked(spark, d), K))


def graph_expand(spark, d):
    """Nodes two hops from the query nodes in the lowest layer of the graphs."""
    edges = hnsw.edges(_stored(spark, _plain(_vectors(spark, d)), "hnsw").nodes()).filter("layer = 0").select("src", "dst")
    hop = _asked(spark, d).select(F.col("query_id").alias("src"), "query_id").join(edges, "src").select("query_id", F.col("dst").alias("src")).distinct()
    return hop.join(edges, "src").select("query_id", F.col("dst").alias("vec_id")).distinct()


QUERIES = {
    f.__name__: f
    for f in (
        dot_products, l2_distance, cosine_unnormalized, vector_norms, normalize, vector_scan_stats, vector_lookup, mean_pool, masked_pool, knn_exact, knn_batch, knn_filtered, knn_exclude, multi_query, knn_graph, ivf_assign, ivf_postings,
        ivf_list_sizes, kmeans_step, kmeans_3, kmeans_shift, ivf_probe, ivf_search, ivf_roundtrip, ivf_add, index_add, index_recall, recall_at_k, missed_neighbours, hnsw_levels, hnsw_roundtrip, hnsw_search, graph_expand,
    )
}

_PAIR = "FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"
_DOT = "list_inner_product({}::DOUBLE[], {}::DOUBLE[])"
_AB = _DOT.format("a.embedding", "b.embedding")
_ASKED = "q AS (SELECT vec_id AS query_id, embedding AS qe, label AS ql FROM embeddings WHERE vec_id % 20 = 0)"
_C0 = f"c0 AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS cid, embedding::DOUBLE[] AS c FROM (SELECT * FROM embeddings ORDER BY md5(vec_id::VARCHAR) LIMIT {LISTS}))"
_HALF = _C0.replace("FROM embeddings", "FROM embeddings WHERE vec_id % 2 = 0")


def _top(source: str, k: int = K, more: str = "") -> str:
    return f"SELECT query_id, rank, vec_id, round(score, 6) AS score{more} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) - 1 AS rank FROM ({source})) WHERE rank < {k}"


def _search(where: str = "true") -> str:
    return f"SELECT query_id, vec_id, {_DOT.format('qe', 'embedding')} AS score FROM q, embeddings WHERE {where}"


def _assigned(n: int) -> str:
    return f"a{n} AS (SELECT vec_id, arg_max(cid, (list_inner_product(embedding::DOUBLE[], c), -cid)) AS cid FROM embeddings, c{n} GROUP BY vec_id)"


def _round(n: int) -> str:
    """One Lloyd round in SQL: means by position, then unit length."""
    m = n + 1
    return (
        f"{_assigned(n)}, m{m} AS (SELECT cid, pos, avg(x) AS x FROM (SELECT a.cid, unnest(range(0, {DIM})) AS pos, unnest(e.embedding::DOUBLE[]) AS x FROM a{n} a JOIN embeddings e USING (vec_id)) GROUP BY cid, pos), "
        f"c{m} AS (SELECT k.cid, coalesce(list(m.x / s.s ORDER BY m.pos) FILTER (WHERE m.x IS NOT NULL), list_transform(range(0, {DIM}), lambda z: 0.0::DOUBLE)) AS c FROM c{n} k LEFT JOIN m{m} m ON m.cid = k.cid LEFT JOIN (SELECT cid, CASE WHEN sqrt(sum(x * x)) > 0 THEN sqrt(sum(x * x)) ELSE 1 END AS s FROM m{m} GROUP BY cid) s ON s.cid = k.cid GROUP BY k.cid)"
    )


def _flat(n: int) -> str:
    return f"SELECT cid::BIGINT AS cid, pos::BIGINT AS pos, round(x, 6) + 0.0 AS x FROM (SELECT cid, unnest(range(0, {DIM})) AS pos, unnest(c) AS x FROM c{n})"


_C3 = f"{_C0}, {_round(0)}, {_round(1)}, {_round(2)}"
_PROBED = f"p AS (SELECT query_id, qe, cid, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, cid) - 1 AS rank FROM (SELECT query_id, qe, cid, list_inner_product(qe::DOUBLE[], c) AS s FROM q, c3))"
_IVF = f"SELECT p.query_id, e.vec_id, {_DOT.format('p.qe', 'e.embedding')} AS score FROM p JOIN a3 USING (cid) JOIN embeddings e USING (vec_id) WHERE p.rank < {PROBES}"
_LONG_DOT = "list_inner_product(list_transform(qe::DOUBLE[], lambda x: x * (1 + query_id % 7)), list_transform(embedding::DOUBLE[], lambda x: x * (1 + vec_id % 7)))"

ORACLES = {
    "dot_products": f"SELECT a.vec_id, b.vec_id AS next_id, round({_AB}, 6) AS dot {_PAIR}",
    "l2_distance": f"SELECT a.vec_id, b.vec_id AS next_id, round(list_sum(list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 6) AS l2 {_PAIR}",
    "cosine_unnormalized": f"SELECT a.vec_id, b.vec_id AS next_id, round(CASE WHEN a.vec_id % 5 = 0 OR b.vec_id % 5 = 0 THEN 0.0 ELSE {_AB} / (sqrt({_DOT.format('a.embedding', 'a.embedding')}) * sqrt({_DOT.format('b.embedding', 'b.embedding')})) END, 6) AS cosine {_PAIR}",
    "vector_norms": f"SELECT vec_id, round(sqrt({_DOT.format('embedding', 'embedding')}), 6) AS norm FROM embeddings",
    "normalize": f"SELECT vec_id, unnest(range(0, {DIM})) AS pos, round(CASE WHEN vec_id % 3 = 0 THEN 0.0 ELSE unnest(embedding::DOUBLE[]) / sqrt({_DOT.format('embedding', 'embedding')}) END, 6) AS x FROM embeddings",
    "vector_scan_stats": "SELECT count(*) AS n, count_if(embedding IS NOT NULL AND len(embedding) = 128 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)::BIGINT AS usable, count_if(embedding IS NULL)::BIGINT AS nulls, min(len(embedding)) AS min_dim, max(len(embedding)) AS max_dim FROM vector_store",
    "vector_lookup": "SELECT row_id, doc_row, chunk_offset, CASE WHEN NOT isnan(norm) THEN round(norm::DOUBLE, 5) END AS norm FROM vector_store WHERE row_id IN (SELECT row_id FROM chunks WHERE chunk_id = 0)",
    "mean_pool": f"SELECT label, pos, round(avg(x), 6) AS mean FROM (SELECT label, unnest(range(0, {DIM})) AS pos, unnest(embedding::DOUBLE[]) AS x FROM embeddings) GROUP BY label, pos",
    "masked_pool": f"SELECT four, pos, round(sum(x * m) / greatest(sum(m), 1e-9), 6) + 0.0 AS x FROM (SELECT vec_id // 4 AS four, CASE WHEN vec_id % 3 > 0 THEN 1 ELSE 0 END AS m, unnest(range(0, {DIM})) AS pos, unnest(embedding::DOUBLE[]) AS x FROM embeddings) GROUP BY four, pos",
    "knn_exact": f"WITH {_ASKED} {_top(_search())}",
    "knn_batch": f"WITH {_ASKED} {_top(f'SELECT query_id, vec_id, {_LONG_DOT} / (sqrt({_DOT.format("qe", "qe")}) * (1 + query_id % 7) * sqrt({_DOT.format("embedding", "embedding")}) * (1 + vec_id % 7)) AS score FROM q, embeddings WHERE vec_id <> query_id')}",
    "knn_filtered": f"WITH {_ASKED} {_top(_search('label = ql'))}",
    "knn_exclude": f"WITH {_ASKED} {_top(_search('label <> ql'))}",
    "multi_query": f"WITH {_ASKED}, x AS ({_top(_search())}), m AS (SELECT q.ql AS topic, x.vec_id, max(x.score) AS score FROM x JOIN q USING (query_id) GROUP BY 1, 2) SELECT topic, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, vec_id) - 1 AS rank FROM m) WHERE rank < {K}",
    "knn_graph": f"WITH {_ASKED.replace(' WHERE vec_id % 20 = 0', '')}, e AS (SELECT query_id AS src, vec_id AS dst FROM ({_top(_search('vec_id <> query_id'), 8)})) SELECT e.src, e.dst, b.src IS NOT NULL AS mutual FROM e LEFT JOIN e b ON b.src = e.dst AND b.dst = e.src WHERE e.src % 20 = 0",
    "ivf_assign": f"WITH {_C3}, {_assigned(3)} SELECT vec_id, cid FROM a3",
    "ivf_postings": f"WITH {_C3}, {_assigned(3)} SELECT cid, row_number() OVER (PARTITION BY cid ORDER BY vec_id) - 1 AS pos, vec_id FROM a3",
    "ivf_list_sizes": f"WITH {_C3}, {_assigned(3)}, s AS (SELECT c3.cid, count(a3.vec_id) AS n FROM c3 LEFT JOIN a3 USING (cid) GROUP BY c3.cid) SELECT count(*) AS lists, min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean, sum(n)::BIGINT AS total FROM s",
    "kmeans_step": f"WITH {_C0}, {_round(0)} {_flat(1)}",
    "kmeans_3": f"WITH {_C0}, {_round(0)}, {_round(1)}, {_round(2)} {_flat(3)}",
    "kmeans_shift": f"WITH {_C0}, {_round(0)} SELECT round(sqrt(sum(s)), 6) AS shift FROM (SELECT list_sum(list_transform(list_zip(c0.c, c1.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS s FROM c0 JOIN c1 USING (cid))",
    "ivf_probe": f"WITH {_ASKED}, {_C3}, {_PROBED} SELECT query_id, rank, cid, round(s, 6) AS score FROM p WHERE rank < {PROBES}",
    "ivf_search": f"WITH {_ASKED}, {_C3}, {_assigned(3)}, {_PROBED} {_top(_IVF)}",
    "ivf_roundtrip": f"WITH {_C3}, {_assigned(3)} SELECT cid, count(*) AS n, sum(vec_id)::BIGINT AS ids, round(any_value(c[1]), 6) AS head, round(any_value(list_sum(c)), 6) AS total FROM a3 JOIN c3 USING (cid) GROUP BY cid",
    "ivf_add": f"WITH {_HALF}, {_assigned(0)} SELECT cid, count(*) AS n, sum(vec_id)::BIGINT AS ids, round(any_value(c[1]), 6) AS head, round(any_value(list_sum(c)), 6) AS total FROM a0 JOIN c0 USING (cid) GROUP BY cid",
    "index_add": f"WITH {_ASKED} {_top(_search())}",
    "index_recall": "SELECT kind, (SELECT count(*) FROM vector_store WHERE row_id % 20 = 0 AND embedding IS NOT NULL AND len(embedding) = 128 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0) AS queries, true AS found, true AS selective FROM (VALUES ('ivf'), ('hnsw')) t(kind)",
    "hnsw_roundtrip": f"SELECT vec_id, {4 * DIM}::BIGINT AS bytes, true AS linked FROM embeddings",
    "recall_at_k": f"WITH {_ASKED}, {_C3}, {_assigned(3)}, {_PROBED}, x AS ({_top(_search())}), y AS ({_top(_IVF)}), r AS (SELECT x.query_id, count(y.vec_id) / {K}.0::DOUBLE AS recall FROM x LEFT JOIN y USING (query_id, vec_id) GROUP BY x.query_id) SELECT count(*) AS queries, round(avg(recall), 6) AS recall FROM r",
    "missed_neighbours": f"WITH {_ASKED}, {_C3}, {_assigned(3)}, {_PROBED}, x AS ({_top(_search())}), y AS ({_top(_IVF)}) SELECT query_id, vec_id FROM x ANTI JOIN y USING (query_id, vec_id)",
    "hnsw_levels": "WITH x0 AS (SELECT vec_id, (vec_id::UHUGEINT * 11400714819323198485 % 18446744073709551616)::UBIGINT AS x FROM embeddings), x1 AS (SELECT vec_id, (xor(x, x >> 29)::UHUGEINT * 13787848793156543929 % 18446744073709551616)::UBIGINT AS x FROM x0) SELECT vec_id, least(12, floor(-ln((xor(x, x >> 32)::DOUBLE + 1) / 18446744073709551616.0::DOUBLE) / ln(8.0)))::BIGINT AS level FROM x1",
}
