"""Stored indexes over vectors: built once, written as Parquet tables, loaded, appended to and searched; a registry of kinds.

An index is a folder: ``about`` (one JSON line: kind, dimension, parameters), and the tables of its kind. Searching reads the tables;
nothing is trained or built then. All kinds share ``build``, ``load``, ``add`` and ``search(queries, k, exclude)``, whose result is
``(query_id, rank INT, id, score)`` by dot product, ties to the lower id. ``exclude`` (id) is left out before the top k.

Vectors that are null or of another length aren't indexed; an index of no vectors gives no hits.
"""

from __future__ import annotations

import json
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldra.operators import hnsw, ivf, knn

KINDS: dict[str, type[Index]] = {}


class NotBuilt(ValueError):
    """There is no index in the folder."""


def register(name: str):
    """Class decorator: adds a kind of index, of the project or of a caller."""

    def add(kind: type[Index]) -> type[Index]:
        kind.kind = name
        KINDS[name] = kind
        return kind

    return add


class Index:
    """Base of all kinds: a folder with a description and tables."""

    kind = ""
    #: Parameters and their defaults.
    defaults: dict[str, Any] = {}

    def __init__(self, spark: SparkSession, path: str, dim: int, params: dict[str, Any]):
        self.spark, self.path, self.dim, self.params = spark, path, dim, params

    def _table(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def _write(self, df: DataFrame, name: str, mode: str = "overwrite") -> None:
        df.write.mode(mode).parquet(f"{self.path}/{name}")

    def _describe(self) -> None:
        about = json.dumps({"kind": self.kind, "dim": self.dim, "params": self.params})
        self.spark.createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/about")

    def _make(self, vectors: DataFrame) -> None:
        raise NotImplementedError

    def add(self, vectors: DataFrame) -> Index:
        raise NotImplementedError

    def search(self, queries: DataFrame, k: int, exclude: DataFrame | None = None, **over: Any) -> DataFrame:
        raise NotImplementedError

    def count(self) -> int:
        raise NotImplementedError


def _clean(vectors: DataFrame, dim: int) -> DataFrame:
    return vectors.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("embedding")).filter(F.col("id").isNotNull() & (F.size("embedding") == dim))


def _class(kind: str) -> type[Index]:
    if kind not in KINDS:
        raise ValueError(f"unknown index: {kind}")
    return KINDS[kind]


def build(kind: str, vectors: DataFrame, path: str, dim: int, **params: Any) -> Index:
    """Index of ``vectors`` (id, embedding) written to ``path``; what is there is replaced."""
    made = _class(kind)
    unknown = set(params) - set(made.defaults)
    if unknown:
        raise ValueError(f"unknown parameters of {kind}: {sorted(unknown)}")
    index = made(vectors.sparkSession, path, dim, made.defaults | params)
    index._make(_clean(vectors, dim))
    index._describe()
    return index


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/about")
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def load(spark: SparkSession, path: str) -> Index:
    """The index in a folder; ``NotBuilt`` if there is none."""
    if not exists(spark, path):
        raise NotBuilt(f"no index in {path}")
    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    return _class(about["kind"])(spark, path, about["dim"], about["params"])


@register("exact")
class Exact(Index):
    """All vectors, compared in blocks."""

    VECTORS = "id bigint, embedding array<float>"

    def _make(self, vectors: DataFrame) -> None:
        self._write(vectors, "vectors")

    def add(self, vectors: DataFrame) -> Index:
        self._write(_clean(vectors, self.dim), "vectors", "append")
        return self

    def count(self) -> int:
        return self._table("vectors", self.VECTORS).count()

    def search(self, queries: DataFrame, k: int, exclude: DataFrame | None = None, **over: Any) -> DataFrame:
        vectors = self._table("vectors", self.VECTORS)
        vectors = vectors if exclude is None else vectors.join(exclude.select("id"), "id", "left_anti")
        return knn.search(queries, vectors, k, self.dim, id_col="id")


class _Centred(Index):
    """What the kinds with centroids share."""

    CENTROIDS = "cid int, centroid array<double>"

    def _save_centroids(self, centroids: np.ndarray) -> None:
        rows = [(i, x.tolist()) for i, x in enumerate(centroids)]
        self._write(self.spark.createDataFrame(rows, self.CENTROIDS), "centroids")

    def centroids(self) -> np.ndarray:
        rows = sorted(self._table("centroids", self.CENTROIDS).collect())  # at most ivf.MOST_CENTROIDS
        return np.array([r["centroid"] for r in rows], np.float64).reshape(-1, self.dim)

    def _trained(self, vectors: DataFrame, k: int) -> np.ndarray:
        return ivf.train(vectors, k, self.params["rounds"], "id", sample=self.params["sample"]) if k else np.zeros((0, self.dim))


@register("ivf")
class Inverted(_Centred):
    """Inverted lists. ``lists`` 0: four times the root of the number of vectors; ``probes`` 0: as many as find ``share`` of the ``near``
    exact neighbours of some vectors, measured when the index is built; ``sample`` 0: see ``ivf.train``."""

    defaults = {"lists": 0, "probes": 0, "share": 0.95, "near": 50, "rounds": 20, "sample": 0}
    LISTS = "cid int, id bigint, vec array<float>"

    def _make(self, vectors: DataFrame) -> None:
        n = vectors.count()
        k = min(self.params["lists"] or round(4 * n**0.5), ivf.MOST_CENTROIDS, n)
        centroids = self._trained(vectors, k)
        self._save_centroids(centroids)
        self._append(vectors, centroids, "overwrite")
        if not self.params["probes"]:
            self.params["probes"] = ivf.probes_needed(self.lists().select("id", F.col("vec").alias("embedding")), centroids, self.params["share"], self.params["near"], id_col="id") if k else 1

    def _append(self, vectors: DataFrame, centroids: np.ndarray, mode: str) -> None:
        lists = ivf.listed(vectors, centroids, "id") if len(centroids) else self.spark.createDataFrame([], self.LISTS)
        # in order of list, so that a filter on the lists probed skips the files and row groups of the others
        self._write(lists.repartitionByRange("cid", "id").sortWithinPartitions("cid", "id") if len(centroids) else lists, "lists", mode)
        every = self._table("lists", self.LISTS)
        self._write(every.groupBy("cid").count(), "sizes")

    def lists(self) -> DataFrame:
        return self._table("lists", self.LISTS)

    def add(self, vectors: DataFrame) -> Index:
        """New vectors go to the lists of the centroids that are there; the first ones of an empty index train them."""
        centroids = self.centroids()
        if len(centroids):
            self._append(_clean(vectors, self.dim), centroids, "append")
        else:
            self._make(_clean(vectors, self.dim))
            self._describe()
        return self

    def count(self) -> int:
        return self.lists().count()

    def search(self, queries: DataFrame, k: int, exclude: DataFrame | None = None, **over: Any) -> DataFrame:
        """``probes`` lists of each query, and more until they hold ``k`` vectors."""
        centroids = self.centroids()
        if not len(centroids):
            return self.spark.createDataFrame([], "query_id bigint, rank int, id bigint, score double")
        sizes = np.zeros(len(centroids), np.int64)
        for r in self._table("sizes", "cid int, count bigint").collect():  # a row for each centroid at most
            sizes[r["cid"]] = r["count"]
        lists = self.lists()
        if exclude is not None:
            lists = lists.join(exclude.select("id"), "id", "left_anti")
            sizes = ivf.list_sizes(lists, len(centroids))
        probes = over.get("probes") or self.params["probes"]
        return ivf.search_lists(queries, lists, centroids, k, probes, fill=True, sizes=sizes)


@register("hnsw")
class SmallWorld(_Centred):
    """Graphs of shards. ``links`` a node makes among ``candidates``; ``ef`` nodes kept in a search; see ``hnsw``."""

    defaults = {"links": 12, "candidates": 16, "ef": 100, "shard_rows": hnsw.SHARD_ROWS, "probes": hnsw.PROBES, "margin": hnsw.MARGIN, "exact": 2048, "rounds": 10, "sample": 0}

    def _nodes(self, vectors: DataFrame, centroids: np.ndarray, first_part: int = 0) -> DataFrame:
        p = self.params
        return hnsw.build(vectors, centroids, self.dim, "id", "embedding", p["shard_rows"], first_part, p["links"], p["candidates"], p["exact"])

    def _make(self, vectors: DataFrame) -> None:
        n = vectors.count()
        centroids = self._trained(vectors, hnsw.shards_for(n, self.params["shard_rows"]) if n else 0)
        self._save_centroids(centroids)
        self._write(self._nodes(vectors, centroids) if n else self.spark.createDataFrame([], hnsw.NODES), "nodes")

    def nodes(self) -> DataFrame:
        return self._table("nodes", hnsw.NODES)

    def add(self, vectors: DataFrame) -> Index:
        """New vectors become further parts of the shards that are there."""
        centroids = self.centroids()
        if len(centroids):
            last = self.nodes().agg(F.max("part")).first()[0]
            self._write(self._nodes(_clean(vectors, self.dim), centroids, 0 if last is None else last + 1), "nodes", "append")
        else:
            self._make(_clean(vectors, self.dim))
        return self

    def count(self) -> int:
        return self.nodes().count()

    def search(self, queries: DataFrame, k: int, exclude: DataFrame | None = None, **over: Any) -> DataFrame:
        p = self.params | over
        centroids = self.centroids()
        if not len(centroids):
            return self.spark.createDataFrame([], "query_id bigint, rank int, id bigint, score double")
        return hnsw.search_nodes(queries, self.nodes(), centroids, k, self.dim, p["ef"], p["probes"], p["margin"], exclude=exclude)
