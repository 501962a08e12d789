"""Reranking, prompt assembly and answers for many questions in one plan."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldra.functions import text as T
from veldra.sources.http import post_json, with_retries

#: Scorers of (query, passage) by name: each makes a DOUBLE column of the two.
SCORERS: dict[str, Callable[[Column, Column], Column]] = {}


def scorer(name: str):
    def add(make: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
        SCORERS[name] = make
        return make

    return add


def overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct words; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either > 0, both / either).otherwise(F.lit(0.0))


@scorer("overlap")
def word_overlap(query: Column, passage: Column) -> Column:
    """Share of words that query and passage have in common: the offline default."""
    return overlap(T.tokens(query), T.tokens(passage))


_models: dict[str, Any] = {}  # of this worker


def pair_scorer(load: Callable[[], Any], key: str) -> Callable[[Column, Column], Column]:
    """Scorer from a model that scores lists of pairs: ``load`` is called once per worker; of a result in two columns the second counts."""

    def make(query: Column, passage: Column) -> Column:
        @F.pandas_udf("double")
        def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for queries, passages in batches:
                if key not in _models:
                    _models[key] = load()
                scores = np.asarray(_models[key](list(zip(queries.fillna(""), passages.fillna("")))), np.float64)
                yield pd.Series(scores[:, 1] if scores.ndim == 2 and scores.shape[1] > 1 else scores.reshape(-1))

        return run(query, passage)

    return make


def cross_encoder(source: str) -> Callable[[Column, Column], Column]:
    """Scorer from a cross encoder of the sentence_transformers library; an error on the driver where that is missing."""
    if importlib.util.find_spec("sentence_transformers") is None:
        raise RuntimeError(f"reranker {source} needs the library sentence_transformers")
    return pair_scorer(lambda: importlib.import_module("sentence_transformers").CrossEncoder(source).predict, source)


#: Known cross encoders by name.
ENCODERS = {"bge-reranker-base": "BAAI/bge-reranker-base", "ms-marco-MiniLM": "cross-encoder/ms-marco-MiniLM-L-6-v2"}


def scorer_of(name: str) -> Callable[[Column, Column], Column]:
    """The scorer of a name; one that isn't known is an error."""
    if name in SCORERS:
        return SCORERS[name]
    if name in ENCODERS:
        return cross_encoder(ENCODERS[name])
    raise ValueError(f"unknown reranker: {name}")


def unranked(candidates: DataFrame, k: int, order: str = "retrieved_rank") -> DataFrame:
    """The first ``k`` passages as they were retrieved, with ``rank`` from 0: the way without a reranker."""
    return candidates.filter(F.col(order) < k).withColumn("rank", F.col(order))


def rerank(candidates: DataFrame, k: int | None, score: Column, order: str = "retrieved_rank") -> DataFrame:
    """The ``k`` best passages of each question (all if None), stable in the order of retrieval, with ``rank`` from 0."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), order)
    ranked = candidates.withColumn("score", score).withColumn("rank", F.row_number().over(w) - 1)
    return ranked if k is None else ranked.filter(F.col("rank") < k)


def budgeted(passages: DataFrame, budget: int = 15_000) -> DataFrame:
    """Passages in rank order while the budget of characters lasts; the one that crosses it is clipped. Adds ``line``."""
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.length("text").cast("bigint")).over(w), F.lit(0))
    kept = passages.withColumn("used", used).filter(F.col("used") < budget)
    clipped = F.substring(F.col("text"), F.lit(1), F.least(F.length("text").cast("bigint"), F.lit(budget) - F.col("used")).cast("int"))
    return kept.withColumn("clipped", clipped).withColumn("line", F.concat(F.lit("Document "), (F.col("rank") + 1).cast("string"), F.lit(": "), F.col("clipped"))).drop("used")


def documents(passages: DataFrame, budget: int = 15_000) -> DataFrame:
    """``(query_id, query, documents)``: the passages of each question in one text."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n\n")
    return budgeted(passages, budget).groupBy("query_id", "query").agg(lines.alias("documents"))


def replug(docs: Column, query: Column) -> Column:
    return F.concat(docs, F.lit("\n\nQuestion: "), query, F.lit("\nAnswer:"))


def rag_sequence(docs: Column, query: Column) -> Column:
    return F.concat(F.lit("Context:\n"), docs, F.lit("\n\nQuestion: "), query, F.lit("\nAnswer:"))


def separate(passages: DataFrame, most: int = 20) -> DataFrame:
    """One prompt row per passage, for decoders that fuse passages."""
    rows = passages.filter(F.col("rank") < most)
    return rows.withColumn("prompt", F.concat(F.lit("question: "), F.col("query"), F.lit(" context: "), F.col("text")))


def chat(base_url: str, model: str, api_key: str = "", max_tokens: int = 1024, temperature: float = 0.0, post: Callable[[str, dict, dict], dict] = post_json, **more: Any) -> Callable[[str], str]:
    """Call of a language model behind a ``/chat/completions`` service."""

    def call(prompt: str) -> str:
        body = {"model": model, "messages": [{"role": "user", "content": prompt}], "max_tokens": max_tokens, "temperature": temperature, **more}
        return with_retries(lambda: post(base_url.rstrip("/") + "/chat/completions", body, {"Authorization": f"Bearer {api_key}"}))["choices"][0]["message"]["content"]

    return call


def answer(prompts: DataFrame, call: Callable[[str], str] | None = None) -> DataFrame:
    """Answer of each prompt: by ``call`` (prompt to text, run on the workers), and where that fails, or without it, the offline one."""
    offline = T.fallback_answer(F.col("prompt"))
    if call is None:
        return prompts.withColumn("answer", offline)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(prompt: str | None) -> str | None:
            try:
                return None if prompt is None else call(prompt)
            except Exception:  # noqa: BLE001 - any failure of the service has the offline answer
                return None

        for texts in batches:
            yield texts.map(one)

    return prompts.withColumn("answer", F.coalesce(run(F.col("prompt")), offline))
