"""Embedding providers: what turns texts into vectors in a worker."""

from __future__ import annotations

import importlib.util
import os
import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Loaded models of this worker process.
_cache: dict[str, Callable[[Sequence[str]], np.ndarray]] = {}

#: Short names and the models they stand for.
ALIASES = {
    "all-MiniLM-L6-v2": "sentence-transformers/all-MiniLM-L6-v2",
    "all-mpnet-base-v2": "sentence-transformers/all-mpnet-base-v2",
}


def hashed_ngrams(texts: Sequence[str], dim: int = 64, n: int = 3) -> np.ndarray:
    """Deterministic vectors of hashed character n-grams, at length 1: needs no model and no network."""
    out = np.zeros((len(texts), dim))
    for row, text in zip(out, texts, strict=True):
        padded = f" {text.lower()} "
        for i in range(max(1, len(padded) - n + 1)):
            h = zlib.crc32(padded[i : i + n].encode())
            row[h % dim] += 1.0 if h >> 31 else -1.0
        length = np.sqrt(row @ row)
        if length:
            row /= length
    return out


def _sentence_transformer(model: str, force_cpu: bool):
    from sentence_transformers import SentenceTransformer

    try:
        loaded = SentenceTransformer(model, device="cpu" if force_cpu else None)
    except RuntimeError as e:
        if force_cpu or "out of memory" not in str(e).lower():
            raise
        loaded = SentenceTransformer(model, device="cpu")
    return lambda texts: np.asarray(loaded.encode(list(texts), batch_size=64))


def _fastembed(model: str):
    from fastembed import TextEmbedding

    name = ALIASES.get(model, model)
    offered = [m["model"] for m in TextEmbedding.list_supported_models()]
    if name not in offered:
        raise ValueError(f"fastembed has no model {name}; it has {', '.join(offered[:10])} and {max(len(offered) - 10, 0)} more")
    loaded = TextEmbedding(model_name=name)
    return lambda texts: np.stack(list(loaded.embed(list(texts))))


def _openai(model: str):
    from openai import OpenAI

    client = OpenAI(api_key=_key("OPENAI_API_KEY"))
    return lambda texts: np.array([d.embedding for d in client.embeddings.create(input=list(texts), model=model).data])


def _gemini(model: str):
    import google.generativeai as genai

    genai.configure(api_key=_key("GEMINI_API_KEY"))
    return lambda texts: np.array([genai.embed_content(model=model, content=t)["embedding"] for t in texts])


def _key(name: str) -> str:
    """Read in the worker: keys never stand in a plan."""
    if not os.environ.get(name):
        raise ValueError(f"set {name}")
    return os.environ[name]


#: Package that each provider needs.
PACKAGES = {"hashed": None, "sentence-transformer": "sentence_transformers", "fastembed": "fastembed", "openai": "openai", "google": "google.generativeai"}

#: Other names of providers, and the services' own models.
PROVIDERS = {"sentence-transformers": "sentence-transformer", "gemini": "google"}
DEFAULT_MODELS = {"openai": "text-embedding-ada-002", "google": "models/embedding-001"}
KEYS = {"openai": "OPENAI_API_KEY", "google": "GEMINI_API_KEY"}


def load(provider: str, model: str = "", force_cpu: bool = True, cache: bool = True) -> Callable[[Sequence[str]], np.ndarray]:
    provider = PROVIDERS.get(provider, provider)
    if provider not in PACKAGES:
        raise ValueError(f"provider is one of {', '.join(PACKAGES)}, not {provider}")
    key = f"{provider}_{model}_{force_cpu}"
    if key in _cache:
        return _cache[key]
    makers = {"hashed": lambda: hashed_ngrams, "sentence-transformer": lambda: _sentence_transformer(model, force_cpu), "fastembed": lambda: _fastembed(model), "openai": lambda: _openai(model), "google": lambda: _gemini(model)}
    made = makers[provider]()
    if cache:
        _cache[key] = made
    return made


def cached_models() -> list[str]:
    return sorted(_cache)


def clear_model_cache() -> None:
    _cache.clear()


def available(package: str | None) -> bool:
    try:
        return package is None or importlib.util.find_spec(package) is not None
    except ModuleNotFoundError:
        return False


def with_embeddings(df: DataFrame, text_col: str, provider: str | Callable[[Sequence[str]], np.ndarray] = "hashed", model: str = "", output: str = "embedding", force_cpu: bool = True) -> DataFrame:
    """df with an array<float> column. A null text has a null vector. A callable stands for itself."""
    provider = PROVIDERS.get(provider, provider) if isinstance(provider, str) else provider
    if isinstance(provider, str) and provider not in PACKAGES:
        raise ValueError(f"provider is one of {', '.join(PACKAGES)}, not {provider}")

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load(provider, model, force_cpu) if isinstance(provider, str) else provider
        for s in batches:
            given = s.notna().to_numpy()
            out = pd.Series([None] * len(s), dtype=object)
            if given.any():
                out[given] = pd.Series([np.asarray(v, np.float32).tolist() for v in encode(list(s[given]))], index=np.flatnonzero(given))
            yield out

    # Called nondeterministic, the optimizer never evaluates it a second time for a filter.
    return df.withColumn(output, run.asNondeterministic()(F.col(text_col)))


def embed_texts(spark, texts: str | Iterable[str], provider="hashed", **options) -> np.ndarray:
    """One vector for a string, a matrix for a list."""
    single = isinstance(texts, str)
    rows = [(i, t) for i, t in enumerate([texts] if single else texts)]
    df = with_embeddings(spark.createDataFrame(rows, "i int, text string"), "text", provider, **options)
    out = np.array([r["embedding"] for r in df.orderBy("i").collect()], dtype=np.float32)
    return out[0] if single else out
