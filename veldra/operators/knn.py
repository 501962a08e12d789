"""Exact nearest neighbours of a stated query set, in blocks.

Vectors and queries are cut into blocks by a hash of the id; each query block meets each vector block in one task as a matrix
product, and the ``k`` best of every block pair are merged by a window limit. No task ever holds more than one block of each.
Ties go to the lower id. Queries or vectors that are null or of another length have no result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 20_000


def matrix(column, dim: int) -> np.ndarray:
    """Rows of a list column as a DOUBLE matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def search(queries: DataFrame, vectors: DataFrame, k: int, dim: int, id_col: str = "vec_id", query_col: str = "query_id", vector_col: str = "embedding", normalized: bool = True, same: str | None = None, differ: str | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(query_id, rank INT, id, score)``, rank from 0, best first; the score is the dot product, or the cosine if not ``normalized``.

    ``same``/``differ``: a BIGINT column that query and neighbour must share, or must not (filters before the top k).
    """
    n, m = vectors.count(), queries.count()
    vb, qb = max(1, -(-n // block_rows)), max(1, -(-m // block_rows))
    extra = same or differ
    spread = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    side = lambda df, key: df.filter(F.col(vector_col).isNotNull() & (F.size(vector_col) == dim)).select(F.col(key).cast("long").alias("id"), F.col(vector_col).alias("vec"), (F.col(extra).cast("long") if extra else F.lit(0).cast("long")).alias("tag"))
    left = side(queries, query_col).withColumn("q", F.pmod(F.xxhash64("id"), F.lit(qb)).cast("int")).withColumn("v", spread(vb))
    right = side(vectors, id_col).withColumn("v", F.pmod(F.xxhash64("id"), F.lit(vb)).cast("int")).withColumn("q", spread(qb))

    def pair(a: pa.Table, b: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not a.num_rows or not b.num_rows:
            return empty
        x, y = matrix(a["vec"], dim), matrix(b["vec"], dim)
        ids = b["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        y, ids, tags = y[order], ids[order], b["tag"].to_numpy()[order]
        if not normalized:
            x, y = (z / np.where((s := np.linalg.norm(z, axis=1)) > 0, s, 1)[:, None] for z in (x, y))
        out = []
        for at in range(0, len(x), 256):
            s = x[at : at + 256] @ y.T
            if extra:
                alike = a["tag"].to_numpy()[at : at + 256][:, None] == tags[None, :]
                s = np.where(alike if same else ~alike, s, -np.inf)
            top = np.argsort(-s, axis=1, kind="stable")[:, :k]
            best = np.take_along_axis(s, top, 1)
            ok = np.isfinite(best)
            who = np.broadcast_to(a["id"].to_numpy()[at : at + 256][:, None], top.shape)
            out.append(pa.table({"query_id": who[ok], "id": ids[top[ok]], "score": best[ok]}))
        return pa.concat_tables(out)

    found = left.groupBy("q", "v").cogroup(right.groupBy("q", "v")).applyInArrow(pair, "query_id bigint, id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return found.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < k).select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")
