"""Facade over the operators: ingest documents into a Parquet store, search it, answer questions; many questions in one plan."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from veldra.functions import text as T
from veldra.operators import chunking, embed, indexes, knn, rank, store
from veldra.runtime import materialize
from veldra.sources.config import Config
from veldra.sources.documents import with_defaults

STORE = "row_id bigint, doc_id string, chunk_id int, text string, token_start bigint, token_end bigint, metadata map<string,string>, embedding array<float>, norm float"
COLUMNS = [c.split()[0] for c in STORE.split(", ")]


def make_index(kind: str, dim: int, /, **params) -> Callable[[DataFrame, DataFrame, int], DataFrame]:
    """Search function ``(queries, vectors, k)`` over vectors (row_id, embedding) that have no stored index: it is built in the scratch folder at each call."""
    if kind not in indexes.KINDS:
        raise ValueError(f"unknown index: {kind}")
    known = {k: v for k, v in params.items() if k in indexes.KINDS[kind].defaults}

    def search(q: DataFrame, v: DataFrame, k: int) -> DataFrame:
        from veldra.runtime import scratch_path

        index = indexes.build(kind, v.withColumnRenamed("row_id", "id"), scratch_path(v.sparkSession, kind), dim, **known)
        return index.search(q, k)

    return search


@dataclass
class Pipeline:
    """Chunks, vectors and row numbers live in one Parquet table at ``path``, a folder per ingest; its index lies beside it.

    An ingest that comes again under the same name replaces itself. The index is brought up to date by each ingest.
    """

    spark: SparkSession
    path: str
    config: Config = field(default_factory=Config)
    call: Callable[[str], str] | None = None

    @property
    def dim(self) -> int:
        return embed.resolve(self.config.get("embedding", "model"), dim=self.config.get("embedding", "dim")).model.dim

    def create(self) -> DataFrame:
        """An empty store, unless there is one."""
        if not self._there(self.path):
            self.spark.createDataFrame([], STORE).write.parquet(f"{self.path}/batch=none")
        return self.stored()

    def _there(self, path: str) -> bool:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target)

    def stored(self) -> DataFrame:
        """The store, empty before the first ingest. A folder of other columns is an error."""
        try:
            found = self.spark.read.parquet(self.path)
        except AnalysisException:
            return self.spark.createDataFrame([], STORE)
        missing = set(COLUMNS) - set(found.columns)
        if missing:
            raise ValueError(f"no store of this kind in {self.path}: without {sorted(missing)}")
        return self.spark.read.schema(STORE).parquet(self.path).select(*COLUMNS)

    def vectors(self, row_ids: list[int]) -> DataFrame:
        """``(row_id, embedding, norm, doc_id, chunk_id)`` of stored rows; a number that isn't there is an error."""
        found = self.stored().filter(F.col("row_id").isin([int(i) for i in row_ids])).select("row_id", "embedding", "norm", "doc_id", "chunk_id")
        missing = set(row_ids) - {r["row_id"] for r in found.select("row_id").collect()}  # as many as were asked for
        if missing:
            raise IndexError(f"no rows {sorted(missing)}")
        return found

    def chunks_of(self, documents: DataFrame) -> DataFrame:
        """Numbered, embedded chunks of documents (id, text, metadata), without row numbers."""
        c = self.config.values["chunking"]
        params = {} if c["strategy"] == "semantic" else {"size": c["chunk_size"], "overlap": c["chunk_overlap"]}
        rows = chunking.chunk(with_defaults(documents).select(F.col("id").alias("doc_id"), "text", "metadata"), c["strategy"], keep=("doc_id", "metadata"), **params)
        return self._normed(embed.embed(rows.withColumnRenamed("chunk", "text"), self.config.get("embedding", "model"), dim=self.config.get("embedding", "dim")))

    def _normed(self, rows: DataFrame) -> DataFrame:
        size = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
        return rows.withColumn("norm", size.cast("float")).withColumn("embedding", F.col("embedding").cast("array<float>"))

    def ingest(self, documents: DataFrame, name: str | None = None) -> dict:
        """Chunks of documents into the store; row numbers go on from the last one. Returns counts and the seconds of each stage."""
        return self._add(self.chunks_of(documents), ["doc_id", "chunk_id"], name)

    def add_vectors(self, rows: DataFrame, name: str | None = None) -> dict:
        """Rows that have vectors (all columns of the store but row_id and norm); another length than the store's is an error."""
        wrong = rows.filter(F.col("embedding").isNull() | (F.size("embedding") != self.dim)).limit(1).count()
        if wrong:
            raise ValueError(f"vectors of {self.dim} dimensions are needed")
        return self._add(self._normed(rows), ["doc_id", "chunk_id"], name)

    def _add(self, rows: DataFrame, order: list[str], name: str | None) -> dict:
        began = time.perf_counter()
        folder = f"{self.path}/batch={name or uuid.uuid4().hex}"
        again = self._there(folder)
        others = self.spark.read.parquet(self.path).filter(F.col("batch") != (name or "")) if self._there(self.path) else self.stored()
        last, before = others.agg(F.max("row_id"), F.count("*")).first()
        base = 0 if last is None else last + 1
        made = materialize(store.with_row_ids(rows, order, base), "ingest")
        added = made.count()
        embedded = time.perf_counter()
        if added or again:
            made.select(*COLUMNS).write.mode("overwrite").parquet(folder)
        written = time.perf_counter()
        if self._index_path is None:
            pass
        elif again or not indexes.exists(self.spark, self._index_path):
            self.build_index()
        elif added:
            indexes.load(self.spark, self._index_path).add(made.select(F.col("row_id").alias("id"), "embedding"))
        ended = time.perf_counter()
        stages = {"chunk_and_embed": embedded - began, "write": written - embedded, "index": ended - written}
        return {"chunks": added, "vectors_added": added, "total_vectors": before + added, "time": ended - began, "stages": stages}

    @property
    def _index_path(self) -> str | None:
        """Folder of the stored index; the store itself is what an exact search reads."""
        kind = self.config.get("index", "kind")
        return None if kind == "exact" else f"{self.path.rstrip('/')}-{kind}"

    def build_index(self) -> None:
        """Builds the index of the configured kind over the whole store, in the place of the one that is there."""
        if self._index_path is not None:
            index = self.config.values["index"]
            known = indexes._class(index["kind"]).defaults
            rows = self.stored().select(F.col("row_id").alias("id"), "embedding")
            indexes.build(index["kind"], rows, self._index_path, self.dim, **{k: v for k, v in index.items() if k in known})

    def search(self, questions: DataFrame, k: int = 0, exclude: DataFrame | None = None) -> DataFrame:
        """``questions`` (query_id, query): the k best passages of each; ``exclude`` (row_id) is left out before the top k."""
        k = k or self.config.get("retrieval", "top_k")
        table = self.stored()
        asked = embed.embed(questions, self.config.get("embedding", "model"), text_col="query", query=True, dim=self.config.get("embedding", "dim")).select("query_id", F.col("embedding").cast("array<float>").alias("embedding"))
        if self._index_path is None or not self._there(self.path):
            held = table if exclude is None else table.join(exclude, "row_id", "left_anti")
            hits = knn.search(asked, held.select("row_id", "embedding"), k, self.dim, id_col="row_id")
        else:
            hits = indexes.load(self.spark, self._index_path).search(asked, k, None if exclude is None else exclude.select(F.col("row_id").alias("id")))
        found = hits.withColumnsRenamed({"id": "row_id", "rank": "retrieved_rank", "score": "retrieved_score"}).join(table.drop("embedding"), "row_id")
        return found.join(questions, "query_id")

    def rerank(self, found: DataFrame, k: int = 0) -> DataFrame:
        """The ``k`` best passages by the configured reranker, or the first ones as they were found if reranking is off."""
        k = k or self.config.get("retrieval", "final_k")
        if not self.config.get("reranking", "enabled"):
            return rank.unranked(found, k)
        return rank.rerank(found, k, rank.scorer_of(self.config.get("reranking", "model"))(F.col("query"), F.col("text")))

    def _prompts(self, best: DataFrame) -> DataFrame:
        prompts = rank.documents(best, self.config.get("generation", "budget"))
        make = rank.rag_sequence if self.config.get("generation", "strategy") == "rag_sequence" else rank.replug
        return prompts.select("query_id", make(F.col("documents"), F.col("query")).alias("prompt"))

    def _answered(self, questions: DataFrame, prompts: DataFrame) -> DataFrame:
        llm = self.config.values["llm"]
        call = self.call or (rank.chat(**llm) if llm["base_url"] else None)
        return rank.answer(questions.join(prompts, "query_id", "left"), call).withColumn("answer", F.coalesce("answer", F.lit(T.NO_ANSWER)))

    def answer(self, questions: DataFrame) -> DataFrame:
        """Prompt and answer of each question; a question without passages gets the fixed answer. The language model is ``call``, or the configured one, or none."""
        return self._answered(questions, self._prompts(self.rerank(self.search(questions))))

    def answer_timed(self, questions: DataFrame, observe: Callable[[str, float], None] | None = None) -> tuple[DataFrame, dict[str, float]]:
        """``answer`` with each stage written before the next, and the seconds of each and of all; ``observe`` is told each stage as it ends."""
        began = time.perf_counter()
        seconds: dict[str, float] = {}

        def stage(name: str, df: DataFrame) -> DataFrame:
            at = time.perf_counter()
            out = materialize(df, name)
            seconds[name] = time.perf_counter() - at
            if observe is not None:
                observe(name, seconds[name])
            return out

        found = stage("retrieve", self.search(questions))
        best = stage("rerank", self.rerank(found))
        out = stage("generate", self._answered(questions, self._prompts(best)))
        seconds["total"] = time.perf_counter() - began
        return out, seconds
