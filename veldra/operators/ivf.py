"""Inverted-file index: training, assignment, posting lists, probing and search.

Centroids are bounded by ``MOST_CENTROIDS`` and live on the driver; every pass over the vectors is one map with the centroids
broadcast and, for a Lloyd round, partial sums per partition, added up per centroid as arrays of bytes. Centroids are trained on a
bounded sample, every vector is assigned. Ties go to the lower centroid.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veldra.operators import knn, ordered
from veldra.operators.knn import matrix
from veldra.runtime import materialize, release

MOST_CENTROIDS = 4096
SAMPLE, SAMPLE_PER_LIST = 100_000, 256  # vectors that centroids are trained on: some per list, bounded
LIST_ROWS = 50_000  # vectors of a list that are scored at once; longer lists are cut
MOST_TASKS = 4096


def initial(vectors: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> np.ndarray:
    """The ``k`` vectors with the least md5 of their id, in order of id: a repeatable random choice."""
    if not 0 < k <= MOST_CENTROIDS:
        raise ValueError(f"1 to {MOST_CENTROIDS} centroids")
    rows = vectors.filter(F.col(vector_col).isNotNull()).orderBy(F.md5(F.col(id_col).cast("string"))).limit(k).collect()
    return np.array([r[vector_col] for r in sorted(rows, key=lambda r: r[id_col])], np.float64)


def listed(vectors: DataFrame, centroids: np.ndarray, id_col: str = "vec_id", vector_col: str = "embedding", with_vector: bool = True) -> DataFrame:
    """Vectors with their nearest centroid by dot product, in one map: ``(cid INT, id, vec)``."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            cid = (matrix(batch.column(1), c.shape[1]) @ c.T).argmax(1) if batch.num_rows else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([pa.array(cid, pa.int32()), batch.column(0), batch.column(1)][: 2 + with_vector], ["cid", "id", "vec"][: 2 + with_vector])

    rows = vectors.select(F.col(id_col).cast("long"), F.col(vector_col).cast("array<float>").alias(vector_col)).filter(F.size(vector_col) == centroids.shape[1])
    return rows.mapInArrow(run, "cid int, id bigint" + ", vec array<float>" * with_vector)


def assign(vectors: DataFrame, centroids: np.ndarray, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(id_col, cid INT)``."""
    return listed(vectors, centroids, id_col, vector_col, False).select(F.col("id").alias(id_col), "cid")


def lloyd_round(vectors: DataFrame, centroids: np.ndarray, vector_col: str = "embedding", unit: bool = True) -> np.ndarray:
    """Means of the vectors of each centroid, of unit length if ``unit``; one without vectors becomes zero."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)
    k, dim = centroids.shape

    def rows(cids: np.ndarray, n: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(cids, pa.int32()), pa.array(n, pa.int64()), pa.array([x.tobytes() for x in sums], pa.binary())], ["cid", "n", "sums"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dim)), np.zeros(k, np.int64)
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch.column(0), dim)
                cid = (v @ shared.value.T).argmax(1)
                np.add.at(sums, cid, v)
                counts += np.bincount(cid, minlength=k)
        has = np.flatnonzero(counts)
        yield rows(has, counts[has], sums[has])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            for cid, n, x in zip(*(batch.column(i).to_pylist() for i in range(3))):
                held = total.setdefault(cid, [0, np.zeros(dim)])
                held[0] += n
                held[1] += np.frombuffer(x)
        yield rows(np.array(list(total), np.int32), np.array([n for n, _ in total.values()], np.int64), [x for _, x in total.values()])

    kind = "cid int, n bigint, sums binary"
    parts = vectors.select(vector_col).filter(F.size(vector_col) == dim).mapInArrow(run, kind).repartition("cid").mapInArrow(merge, kind)
    out = np.zeros((k, dim))
    for cid, n, x in zip(*(c.to_pylist() for c in parts.toArrow().columns)):  # a row for each centroid at most
        out[cid] = np.frombuffer(x) / n
    size = np.linalg.norm(out, axis=1)
    return out / np.where(size > 0, size, 1)[:, None] if unit else out


def fit(vectors: DataFrame, k: int, rounds: int = 20, tolerance: float = 1e-4, id_col: str = "vec_id", vector_col: str = "embedding") -> np.ndarray:
    """Centroids after at most ``rounds`` Lloyd rounds; ends when they move less than ``tolerance`` in all."""
    centroids = initial(vectors, k, id_col, vector_col)
    for _ in range(rounds):
        moved = lloyd_round(vectors, centroids, vector_col)
        shift, centroids = np.linalg.norm(moved - centroids), moved
        if shift < tolerance:
            break
    return centroids


def train(vectors: DataFrame, k: int, rounds: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = 0) -> np.ndarray:
    """``fit`` on a sample by a hash of the id, of about ``sample`` vectors (0: ``SAMPLE_PER_LIST`` a list, ``SAMPLE`` at most)."""
    n = vectors.count()
    k = min(k, n, MOST_CENTROIDS)
    part = min(1.0, (sample or min(SAMPLE, max(k * SAMPLE_PER_LIST, 1000))) / max(n, 1))
    some = vectors.select(id_col, vector_col)
    some = materialize(some if part == 1 else some.filter(F.pmod(F.xxhash64(id_col), F.lit(1_000_003)) < int(np.ceil(part * 1_000_003))), "sample")
    out = fit(some, min(k, max(some.count(), 1)), rounds, id_col=id_col, vector_col=vector_col)
    release(some)
    return out


def postings(assigned: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """Rows of the inverted lists ``(cid, pos, id)``; the position is counted in order of id, in spans of ids, so a long list isn't one task."""
    low, high = assigned.agg(F.min(id_col), F.max(id_col)).first()
    span = max(1024, ((high or 0) - (low or 0)) // 100_000 + 1)
    rows = ordered.running_sum(assigned.select("cid", id_col), "cid", id_col, F.lit(1).cast("bigint"), "_upto", span)
    return rows.select("cid", (F.col("_upto") - 1).alias("pos"), id_col)


def probe(queries: DataFrame, centroids: np.ndarray, n_probe: int, query_col: str = "query_id", vector_col: str = "embedding", sizes: np.ndarray | None = None, k: int = 0) -> DataFrame:
    """The ``n_probe`` best centroids of each query, and with ``sizes`` of the lists further ones until they hold ``k`` vectors: ``(query_id, embedding, rank INT, cid INT, score)``."""
    shared = queries.sparkSession.sparkContext.broadcast((centroids, sizes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, n = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            s = matrix(batch.column(1), c.shape[1]) @ c.T
            top = np.argsort(-s, axis=1, kind="stable")
            keep = np.broadcast_to(np.arange(top.shape[1]) < n_probe, top.shape)
            if n is not None:
                held = n[top]
                keep = keep | (np.cumsum(held, axis=1) - held < k)
            row, rank = np.nonzero(keep)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(rank, pa.int32()), pa.array(top[row, rank], pa.int32()), pa.array(s[row, top[row, rank]])], ["query_id", "embedding", "rank", "cid", "score"])

    rows = queries.select(F.col(query_col).cast("long"), F.col(vector_col).cast("array<float>").alias(vector_col)).filter(F.size(vector_col) == centroids.shape[1])
    return rows.mapInArrow(run, "query_id bigint, embedding array<float>, rank int, cid int, score double")


def score_lists(probed: DataFrame, lists: DataFrame, sizes: np.ndarray, k: int, dim: int, list_rows: int = LIST_ROWS) -> DataFrame:
    """``(query_id, rank, id, score)`` of probed ``(query_id, embedding, cid)`` among ``lists`` (cid, id, vec).

    A list, or a block of a long one, goes to one task before the queries that probe it, which are multiplied with it as they come.
    """
    blocks = np.maximum(1, -(-sizes // list_rows))
    before = np.cumsum(blocks) - blocks
    spark = lists.sparkSession
    # tasks by the number of vectors, as many short lists share one
    tasks = int(np.clip(max(sizes.sum() // list_rows, int(spark.conf.get("spark.sql.shuffle.partitions"))), 1, min(MOST_TASKS, max(blocks.sum(), 1))))
    table = F.broadcast(spark.createDataFrame(pa.table({"cid": pa.array(np.arange(len(sizes)), pa.int32()), "_first": pa.array(before, pa.int64()), "_blocks": pa.array(blocks, pa.int64())})))  # a row for each centroid
    own = lists.join(table, "cid").select((F.col("_first") + F.pmod(F.xxhash64("id"), F.col("_blocks"))).cast("int").alias("slot"), F.lit(0).cast("byte").alias("role"), "id", "vec")
    asked = probed.join(table, "cid").select(F.explode(F.sequence(F.col("_first").cast("int"), (F.col("_first") + F.col("_blocks") - 1).cast("int"))).alias("slot"), F.lit(1).cast("byte").alias("role"), F.col("query_id").alias("id"), F.col("embedding").alias("vec"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, held, v = None, [], [], None
        for batch in batches:
            kinds = np.stack([batch.column(0).to_numpy().astype(np.int64), batch.column(1).to_numpy()], 1)
            cuts = np.flatnonzero(np.append(True, (kinds[1:] != kinds[:-1]).any(1))).tolist() if len(kinds) else []
            for a, b in zip(cuts, [*cuts[1:], len(kinds)]):
                part = batch.slice(a, b - a)
                if kinds[a, 0] != now:
                    now, ids, held, v = kinds[a, 0], [], [], None
                if kinds[a, 1] == 0:
                    ids.append(part.column(2).to_numpy())
                    held.append(matrix(part.column(3), dim))
                    continue
                if not ids:
                    continue
                if v is None:
                    every = np.concatenate(ids)
                    order = np.argsort(every, kind="stable")
                    every, v = every[order], np.concatenate(held)[order]
                for at in range(0, part.num_rows, 256):
                    some = part.slice(at, 256)
                    s = matrix(some.column(3), dim) @ v.T
                    top = np.argsort(-s, axis=1, kind="stable")[:, :k]
                    who = np.broadcast_to(some.column(2).to_numpy()[:, None], top.shape)
                    yield pa.RecordBatch.from_arrays([pa.array(who.ravel()), pa.array(every[top].ravel()), pa.array(np.take_along_axis(s, top, 1).ravel())], ["query_id", "id", "score"])

    placed = own.unionAll(asked).repartitionById(tasks, "slot").sortWithinPartitions("slot", "role")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    found = placed.mapInArrow(run, "query_id bigint, id bigint, score double")
    return found.withColumn("rank", (F.row_number().over(order) - 1).cast("int")).filter(F.col("rank") < k).select("query_id", "rank", "id", "score")


def probes_needed(vectors: DataFrame, centroids: np.ndarray, share: float = 0.95, k: int = 50, asked: int = 200, id_col: str = "vec_id", vector_col: str = "embedding") -> int:
    """The least number of probes with which ``asked`` of the vectors find ``share`` of their exact ``k`` nearest others."""
    dim = centroids.shape[1]
    queries = vectors.orderBy(F.md5(F.col(id_col).cast("string"))).limit(asked).select(F.col(id_col).alias("query_id"), F.col(vector_col).alias("embedding"))
    queries = materialize(queries, "asked")
    near = materialize(knn.search(queries, vectors, k + 1, dim, id_col, vector_col=vector_col).filter("id <> query_id"), "near")
    homes = listed(vectors.join(F.broadcast(near.select(F.col("id").alias(id_col)).distinct()), id_col, "left_semi"), centroids, id_col, vector_col, False)  # at most asked x k
    ranks = near.join(homes, "id").join(probe(queries, centroids, len(centroids)).select("query_id", "cid", F.col("rank").alias("place")), ["query_id", "cid"])
    places = np.sort([r["place"] for r in ranks.select("place").collect()])  # at most asked x k
    release(queries, near)
    return int(places[min(int(np.ceil(share * len(places))), len(places)) - 1]) + 1 if len(places) else 1


def list_sizes(lists: DataFrame, k: int) -> np.ndarray:
    """Sizes of the ``k`` lists, on the driver."""
    out = np.zeros(k, np.int64)
    for r in lists.groupBy("cid").count().collect():  # a row for each centroid at most
        out[r["cid"]] = r["count"]
    return out


def search_lists(queries: DataFrame, lists: DataFrame, centroids: np.ndarray, k: int, n_probe: int, query_col: str = "query_id", vector_col: str = "embedding", fill: bool = False, sizes: np.ndarray | None = None, list_rows: int = LIST_ROWS) -> DataFrame:
    """``search`` in lists that are there; only lists that a query probes are read."""
    sizes = list_sizes(lists, len(centroids)) if sizes is None else sizes
    probed = probe(queries, centroids, n_probe, query_col, vector_col, sizes if fill else None, k)
    wanted = [r["cid"] for r in probed.select("cid").distinct().collect()]  # at most the centroids
    if len(wanted) < len(centroids):
        lists = lists.filter(F.col("cid").isin(wanted))
    return score_lists(probed, lists, sizes, k, centroids.shape[1], list_rows)


def search(queries: DataFrame, vectors: DataFrame, centroids: np.ndarray, k: int, n_probe: int, id_col: str = "vec_id", query_col: str = "query_id", vector_col: str = "embedding", fill: bool = False) -> DataFrame:
    """``(query_id, rank, id, score)`` among the lists of the probed centroids.

    With ``fill`` a query whose lists hold under ``k`` vectors goes on to the next lists until they hold as many.
    """
    return search_lists(queries, listed(vectors, centroids, id_col, vector_col), centroids, k, n_probe, query_col, vector_col, fill)
