"""Embedders: a registry of providers behind one contract, known models, and a deterministic offline default.

A provider turns a list of texts into float32 rows of unit length: ``load`` once per worker, ``embed`` per batch. The default hashes
words: each distinct word adds its sign to one of ``dim`` places, both taken from its md5, and the sum is scaled to length one.

A known model whose library is missing is an error; a name that isn't known gives the default model, with a warning.
"""

from __future__ import annotations

import hashlib
import importlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldra.functions import text as T
from veldra.sources.config import warn
from veldra.sources.http import post_json, with_retries

DEFAULT = "hashing"
MOST_REMOTE = 2000  # texts of one call to a remote service
PROVIDERS: dict[str, type[Provider]] = {}


@dataclass(frozen=True)
class Model:
    """A model as the registry knows it. ``options`` go to the provider (address, key, ``post``)."""

    name: str
    provider: str
    dim: int
    longest: int = 0
    source: str = ""
    batch: int = 32
    normalize: bool = True
    options: dict[str, Any] = field(default_factory=dict)


#: Known models with provider, dimension, longest input and name at their source.
MODELS = {
    m.name: m
    for m in (
        Model("hashing", "hashing", 64), Model("miniLM-L6-v2", "sentence_transformers", 384, 256, "sentence-transformers/all-MiniLM-L6-v2"), Model("bge-base-en", "sentence_transformers", 768, 512, "BAAI/bge-base-en-v1.5"),
        Model("e5-base", "sentence_transformers", 768, 512, "intfloat/e5-base-v2"), Model("nomic-embed-text", "ollama", 768, 8192, "nomic-embed-text"),
    )
}


def register_model(model: Model) -> None:
    MODELS[model.name] = model


def provider(name: str):
    def add(kind: type[Provider]) -> type[Provider]:
        PROVIDERS[name] = kind
        return kind

    return add


class Provider:
    """Contract of all providers; an instance is sent to the workers, what ``load`` makes is not."""

    library = ""

    def __init__(self, model: Model):
        self.model = model

    def check(self) -> None:
        """Raises on the driver if a worker couldn't load the model."""
        if self.library and importlib.util.find_spec(self.library) is None:
            raise RuntimeError(f"model {self.model.name} needs the library {self.library}")

    def load(self) -> Any:
        """What ``rows`` needs, made once per worker."""
        return None

    def rows(self, loaded: Any, texts: list[str]) -> np.ndarray:
        raise NotImplementedError

    def embed(self, texts: list[str]) -> np.ndarray:
        key = (type(self).__name__, self.model.name)
        if key not in _loaded:
            _loaded[key] = self.load()
        parts = [np.asarray(self.rows(_loaded[key], texts[a : a + self.model.batch]), np.float32) for a in range(0, len(texts), self.model.batch)]
        out = np.concatenate(parts) if parts else np.zeros((0, self.model.dim), np.float32)
        if out.shape[1] != self.model.dim:
            raise ValueError(f"model {self.model.name} gave {out.shape[1]} dimensions, not {self.model.dim}")
        return unit(out) if self.model.normalize else out

    def embed_query(self, text: str) -> np.ndarray:
        return self.embed([text])[0]


_loaded: dict[tuple, Any] = {}  # of this worker


def unit(v: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(v, axis=1)
    return (v / np.where(size > 0, size, 1)[:, None]).astype(v.dtype)


@provider("hashing")
class Hashing(Provider):
    def rows(self, loaded: Any, texts: list[str]) -> np.ndarray:
        return hash_texts(texts, self.model.dim)


@provider("sentence_transformers")
class SentenceTransformers(Provider):
    library = "sentence_transformers"

    def load(self) -> Any:
        return importlib.import_module(self.library).SentenceTransformer(self.model.source)

    def rows(self, loaded: Any, texts: list[str]) -> np.ndarray:
        return loaded.encode(texts, batch_size=self.model.batch, show_progress_bar=False, convert_to_numpy=True)


@provider("huggingface")
class HuggingFace(Provider):
    library = "transformers"

    def load(self) -> Any:
        t = importlib.import_module(self.library)
        return t.AutoTokenizer.from_pretrained(self.model.source), t.AutoModel.from_pretrained(self.model.source).eval()

    def rows(self, loaded: Any, texts: list[str]) -> np.ndarray:
        tokenizer, model = loaded
        encoded = tokenizer(texts, padding=True, truncation=True, max_length=self.model.longest or None, return_tensors="pt")
        return masked_mean(model(**encoded).last_hidden_state.detach().numpy(), encoded["attention_mask"].numpy())


def masked_mean(tokens: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean of the token vectors (texts x tokens x dim) whose mask isn't 0; zero where no token counts."""
    weight = mask.astype(tokens.dtype)[:, :, None]
    return (tokens * weight).sum(1) / np.maximum(weight.sum(1), 1e-9)


@provider("openai")
class Remote(Provider):
    """A service with the ``/embeddings`` call: many texts a call, ``MOST_REMOTE`` at most. ``post`` (url, body, headers) may be replaced."""

    def check(self) -> None:
        if not self.model.options.get("api_key"):
            raise ValueError(f"model {self.model.name} needs an api_key")

    def rows(self, loaded: Any, texts: list[str]) -> np.ndarray:
        o = self.model.options
        call = o.get("post", post_json)
        url = o.get("base_url", "https://api.openai.com/v1").rstrip("/") + "/embeddings"
        out = []
        for a in range(0, len(texts), MOST_REMOTE):
            answer = with_retries(lambda a=a: call(url, {"model": self.model.source, "input": texts[a : a + MOST_REMOTE]}, {"Authorization": f"Bearer {o['api_key']}"}))
            out += [x["embedding"] for x in answer["data"]]
        return np.array(out, np.float32)


@provider("ollama")
class Local(Provider):
    """A service on the worker's machine that takes one text a call."""

    def rows(self, loaded: Any, texts: list[str]) -> np.ndarray:
        o = self.model.options
        call = o.get("post", post_json)
        url = o.get("base_url", "http://localhost:11434").rstrip("/") + "/api/embeddings"
        return np.array([with_retries(lambda t=t: call(url, {"model": self.model.source, "prompt": t}, {}))["embedding"] for t in texts], np.float32)


def resolve(name: str | None = None, **options: Any) -> Provider:
    """Provider of a model; ``options`` may hold ``dim`` for the hashing model, and go to remote ones."""
    if name is not None and name not in MODELS:
        warn(f"unknown model, {DEFAULT} instead: {name}")
    known = MODELS.get(name or DEFAULT, MODELS[DEFAULT])
    dim = options.pop("dim", known.dim) if known.provider == "hashing" else known.dim
    made = PROVIDERS[known.provider](Model(**{**known.__dict__, "dim": dim or known.dim, "options": known.options | options}))
    made.check()
    return made


def hash_column(text: Column, dim: int = 64) -> Column:
    """Unit ARRAY<DOUBLE> of hashed words, or the zero vector if there are none."""

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(list(hash_texts(texts.tolist(), dim)))

    return run(F.coalesce(text, F.lit("")))


def hash_steps(some: Column, dim: int = 64) -> Column:
    """Similarity of each text of an array to the one before it, ARRAY<DOUBLE>; the first has 0."""

    @F.pandas_udf("array<double>")
    def run(lists: pd.Series) -> pd.Series:
        sizes = np.array([0 if x is None else len(x) for x in lists], np.int64)
        flat = hash_texts([t for x in lists if x is not None for t in x], dim)
        steps = np.zeros(len(flat))
        steps[1:] = np.einsum("ij,ij->i", flat[1:], flat[:-1])
        ends = np.cumsum(sizes)
        steps[(ends - sizes)[sizes > 0]] = 0.0
        return pd.Series([steps[e - n : e] for e, n in zip(ends, sizes)])

    return run(some)


_hashes: dict[str, int] = {}  # of this worker
MOST_HASHES = 1_000_000


def hash_texts(texts: list[str], dim: int) -> np.ndarray:
    """Rows of hashed words; the words of all texts are found at once and each different one is hashed once."""
    column = pa.array(texts, pa.large_string())
    bare = pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(column), "[^a-z0-9]+", " "), " ")
    parts = pc.split_pattern(bare, " ")
    owner, words = pc.list_parent_indices(parts).to_numpy(), pc.list_flatten(parts)
    if isinstance(words, pa.ChunkedArray):
        words = words.combine_chunks()
    coded = words.dictionary_encode()
    names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
    if len(_hashes) > MOST_HASHES:
        _hashes.clear()
    for w in names:
        if w not in _hashes:
            _hashes[w] = int(hashlib.md5(w.encode()).hexdigest()[:8], 16)
    h = np.array([_hashes[w] for w in names], np.int64)
    counted = np.array([w != "" for w in names], bool)
    pairs = np.unique(owner.astype(np.int64) * max(len(names), 1) + code)
    owner, code = pairs // max(len(names), 1), pairs % max(len(names), 1)
    keep = counted[code] if len(code) else np.zeros(0, bool)
    owner, h = owner[keep], h[code[keep]] if len(code) else np.zeros(0, np.int64)
    out = np.bincount(owner * dim + h % dim, np.where(h // dim % 2 == 0, 1.0, -1.0), minlength=len(texts) * dim).reshape(-1, dim)
    return unit(out)


def embed(df: DataFrame, model: str = DEFAULT, text_col: str = "text", out: str = "embedding", query: bool = False, **options: Any) -> DataFrame:
    """``df`` with the vectors of its texts; null texts have no vector. Models of the e5 family get the prefix of passages, or of queries."""
    made = resolve(model, **options)
    name = f"{model} {made.model.source}".lower()
    source = T.prefixed(F.col(text_col), T.QUERY if query else T.PASSAGE) if "e5" in name or "intfloat" in name else F.col(text_col)
    if isinstance(made, Hashing):
        value = hash_column(source, made.model.dim)
    else:

        @F.pandas_udf("array<float>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                yield pd.Series(list(made.embed(texts.tolist())))

        value = run(F.coalesce(source, F.lit("")))
    return df.withColumn(out, F.when(F.col(text_col).isNotNull(), value))
