"""Sharded small-world graph index: one graph per shard, held as a table of nodes, shard results merged.

A shard holds the vectors nearest to one centroid (trained on a bounded sample); shards over twice ``SHARD_ROWS`` are cut into parts
by a hash of the id. The node table ``(shard, part, pos, id, vec, links)`` has a row per vector: its place in the graph, its parts as
float32 bytes and its links in each layer it belongs to as int32 bytes. Appending vectors makes further parts, graphs of their own.
A query goes to the shards whose centroid is among its ``probes`` nearest and less than ``margin`` behind the nearest, in a task after
the nodes of the part, and streams through the graph. Approximate: gate on recall.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veldra.functions.graph import CANDIDATES, EXACT, OWN, Graph
from veldra.operators import ivf
from veldra.operators.knn import matrix
from veldra.runtime import broadcast_checked, materialize

SHARD_ROWS = 16_000
MOST_TASKS = 4096
PROBES, MARGIN = 8, 0.3
NODES = "shard int, part int, pos int, id bigint, vec binary, links binary"
NAMES = ["shard", "part", "pos", "id", "vec", "links"]


def shards_for(n: int, shard_rows: int = SHARD_ROWS) -> int:
    return int(np.clip(round(n / shard_rows), 1, ivf.MOST_CENTROIDS))


def _runs(batch: pa.RecordBatch, keys: int) -> list[tuple[tuple, int, int]]:
    """Ranges of rows of a batch with the same first ``keys`` columns."""
    if not batch.num_rows:
        return []
    kinds = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(keys)], 1)
    cuts = np.flatnonzero(np.append(True, (kinds[1:] != kinds[:-1]).any(1))).tolist()
    return [(tuple(kinds[a].tolist()), a, b) for a, b in zip(cuts, [*cuts[1:], len(kinds)])]


def _floats(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim)


def _rows(key: tuple, graph: Graph) -> Iterator[pa.RecordBatch]:
    """Node rows of a graph."""
    top = np.array([sum(i < s for s in graph.sizes) for i in range(len(graph.ids))])
    for a in range(0, len(graph.ids), 4096):
        b = min(a + 4096, len(graph.ids))
        links = [b"".join(graph.layers[n][i].tobytes() for n in range(top[i])) for i in range(a, b)]
        columns = [pa.array(np.full(b - a, key[0]), pa.int32()), pa.array(np.full(b - a, key[1]), pa.int32()), pa.array(np.arange(a, b), pa.int32()), pa.array(graph.ids[a:b], pa.int64()), pa.array([x.tobytes() for x in graph.v[a:b]], pa.binary()), pa.array(links, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, NAMES)


def _graph(ids: list[np.ndarray], vectors: list[np.ndarray], links: list[bytes]) -> Graph:
    """The graph of node rows in order of place. A node of n layers has n rows of links, and layers are prefixes of the nodes."""
    flat = [np.frombuffer(x, np.int32) for x in links]
    width = min((len(x) for x in flat), default=1)  # the last node is in the lowest layer alone
    depth = np.array([len(x) // width for x in flat])
    layers = [np.stack([x[n * width : (n + 1) * width] for x in flat[: int((depth > n).sum())]]) for n in range(int(depth.max(initial=0)))]
    return Graph.restored(np.concatenate(ids), np.concatenate(vectors), layers)


def build(vectors: DataFrame, centroids: np.ndarray, dim: int, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, first_part: int = 0, links: int = OWN, candidates: int = CANDIDATES, exact: int = EXACT) -> DataFrame:
    """Node table of the graphs of ``vectors``; parts are numbered from ``first_part``."""
    placed = materialize(ivf.listed(vectors, centroids, id_col, vector_col), "placed")
    sizes = ivf.list_sizes(placed, len(centroids))
    parts = np.maximum(1, -(-sizes // (2 * shard_rows)))
    spark = vectors.sparkSession
    table = F.broadcast(spark.createDataFrame(pa.table({"cid": pa.array(np.arange(len(parts)), pa.int32()), "_parts": pa.array(parts, pa.int64())})))  # a row for each centroid
    rows = placed.join(table, "cid").select(F.col("cid").alias("shard"), (F.pmod(F.xxhash64("id"), F.col("_parts")) + first_part).cast("int").alias("part"), "id", "vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, held = None, [], []

        def close() -> Iterator[pa.RecordBatch]:
            if ids:
                yield from _rows(now, Graph(np.concatenate(ids), np.concatenate(held), candidates, own=links, exact=exact))

        for batch in batches:
            for key, a, b in _runs(batch, 2):
                if key != now:
                    yield from close()
                    now, ids, held = key, [], []
                ids.append(batch.column(2).slice(a, b - a).to_numpy())
                held.append(matrix(batch.column(3).slice(a, b - a), dim).astype(np.float32))
        yield from close()

    return rows.repartition(int(min(MOST_TASKS, parts.sum())), "shard", "part").sortWithinPartitions("shard", "part").mapInArrow(run, NODES)


def search_nodes(queries: DataFrame, nodes: DataFrame, centroids: np.ndarray, k: int, dim: int, ef: int = 64, probes: int = PROBES, margin: float = MARGIN, query_col: str = "query_id", vector_col: str = "embedding", exclude: DataFrame | None = None) -> DataFrame:
    """``(query_id, rank INT, id, score)``: ``k`` nearest of every query by dot product; ``exclude`` (id) leaves the ``ef`` best before the top k."""
    probed = ivf.probe(queries, centroids, probes, query_col, vector_col)
    best = F.max("score").over(Window.partitionBy("query_id"))
    probed = materialize(probed.withColumn("best", best).filter(F.col("score") >= F.col("best") - margin).select("query_id", "embedding", F.col("cid").alias("shard")), "probed")
    wanted = [r["shard"] for r in probed.select("shard").distinct().collect()]  # at most the centroids
    nodes = nodes.filter(F.col("shard").isin(wanted)) if len(wanted) < len(centroids) else nodes
    slots = nodes.select("shard", "part").distinct()
    own = nodes.select("shard", "part", F.lit(0).cast("byte").alias("role"), "pos", "id", "vec", "links")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column(1), dim).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in v], pa.binary()), batch.column(2)], ["id", "vec", "shard"])

    asked = probed.mapInArrow(encode, "id bigint, vec binary, shard int").join(broadcast_checked(slots), "shard")
    asked = asked.select("shard", "part", F.lit(1).cast("byte").alias("role"), F.lit(0).alias("pos"), "id", "vec", F.lit(None).cast("binary").alias("links"))
    take = max(k, ef) if exclude is not None else k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, held, links, graph = None, [], [], [], None
        for batch in batches:
            for key, a, b in _runs(batch, 3):
                part = batch.slice(a, b - a)
                if key[:2] != now:
                    now, ids, held, links, graph = key[:2], [], [], [], None
                if key[2] == 0:
                    ids.append(part.column(4).to_numpy())
                    held.append(_floats(part.column(5), dim))
                    links += part.column(6).to_pylist()
                    continue
                if not ids:
                    continue
                graph = graph or _graph(ids, held, links)
                found, near = graph.search(_floats(part.column(5), dim), take, max(ef, take))
                ok = found >= 0
                who = np.broadcast_to(part.column(4).to_numpy()[:, None], found.shape)
                yield pa.RecordBatch.from_arrays([pa.array(who[ok]), pa.array(found[ok]), pa.array(near[ok].astype(np.float64))], ["query_id", "id", "score"])

    tasks = int(np.clip(slots.count(), 1, MOST_TASKS))
    placed = own.unionAll(asked).repartition(tasks, "shard", "part").sortWithinPartitions("shard", "part", "role", "pos")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    found = placed.mapInArrow(run, "query_id bigint, id bigint, score double")
    found = found if exclude is None else found.join(exclude.select("id"), "id", "left_anti")
    return found.withColumn("rank", (F.row_number().over(order) - 1).cast("int")).filter(F.col("rank") < k).select("query_id", "rank", "id", "score")


def search(queries: DataFrame, vectors: DataFrame, k: int, dim: int, ef: int = 64, id_col: str = "vec_id", query_col: str = "query_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, probes: int = PROBES, margin: float = MARGIN, exact: int = EXACT) -> DataFrame:
    """Search of vectors that have no index yet: the graphs are built for this call."""
    n = vectors.count()
    if not n:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, id bigint, score double")
    centroids = ivf.train(vectors, shards_for(n, shard_rows), 10, id_col, vector_col)
    nodes = materialize(build(vectors, centroids, dim, id_col, vector_col, shard_rows, exact=exact), "nodes")
    return search_nodes(queries, nodes, centroids, k, dim, ef, probes, margin, query_col, vector_col)


def edges(nodes: DataFrame) -> DataFrame:
    """The graphs of a node table as edges ``(shard INT, part INT, layer INT, src, dst)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, links = None, [], []

        def close() -> Iterator[pa.RecordBatch]:
            if not ids:
                return
            every = np.concatenate(ids)
            graph = _graph([every], [np.zeros((len(every), 1), np.float32)], links)
            for layer, flat in enumerate(graph.layers):
                row, column = np.nonzero(flat >= 0)
                fixed = [pa.array(np.full(len(row), x), pa.int32()) for x in (*now, layer)]
                yield pa.RecordBatch.from_arrays([*fixed, pa.array(every[row]), pa.array(every[flat[row, column]])], ["shard", "part", "layer", "src", "dst"])

        for batch in batches:
            for key, a, b in _runs(batch, 2):
                if key != now:
                    yield from close()
                    now, ids, links = key, [], []
                ids.append(batch.column(3).slice(a, b - a).to_numpy())
                links += batch.column(4).slice(a, b - a).to_pylist()
        yield from close()

    rows = nodes.select("shard", "part", "pos", "id", "links").repartition("shard", "part").sortWithinPartitions("shard", "part", "pos")
    return rows.mapInArrow(run, "shard int, part int, layer int, src bigint, dst bigint")
