"""The seams where a user's own parts go in: retrievers, scorers, embedders, rankers, profile builders, models."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scoring


class Retriever(Protocol):
    """Gives (profile_id, item_id, score) of its component; pairs it says nothing about have no row."""

    name: str

    def score(self, candidates: DataFrame, profiles: DataFrame) -> DataFrame: ...


class ProfileBuilder(Protocol):
    def build_implicit(self, collection: DataFrame, max_items: int = 50) -> DataFrame: ...

    def build_explicit(self, collection: DataFrame, max_items: int = 50) -> DataFrame: ...


class Ranker(Protocol):
    def rank(self, scores: DataFrame, top_k: int = 20, min_score: float | None = None) -> DataFrame: ...


class Embedder(Protocol):
    """Vectors of a batch of texts, one row a text; trimmed or filled with zeros to ``dim``."""

    dim: int

    def embed_batch(self, texts: list[str]) -> np.ndarray: ...


class Model(Protocol):
    """A language model outside the engine; called per batch of prompts inside the executors."""

    def complete(self, prompts: list[str]) -> list[str | None]: ...


class HashingEmbedder:
    """A built-in stand-in: signed counts of hashed word and character runs, as a unit vector."""

    def __init__(self, dim: int = 64, run: int = 3):
        self.dim, self.run = dim, run

    def embed_batch(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        for i, t in enumerate(texts):
            t = (t or "").lower()
            for k in range(max(len(t) - self.run + 1, min(len(t), 1))):
                h = int.from_bytes(hashlib.blake2b(t[k : k + self.run].encode("utf-8", "replace"), digest_size=8).digest(), "little")
                out[i, h % self.dim] += 1 if h >> 63 else -1
        return out / (np.linalg.norm(out, axis=1, keepdims=True) + 1e-8)


def fitted(vectors: np.ndarray, dim: int) -> np.ndarray:
    """Trims or fills the rows to ``dim``."""
    return vectors[:, :dim] if vectors.shape[1] >= dim else np.pad(vectors, ((0, 0), (0, dim - vectors.shape[1])))


def embed(df: DataFrame, embedder: Embedder, key: str, body: Column, batch: int = 32) -> DataFrame:
    """(key, vec) by Arrow batches inside the executors."""
    kind = df.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for a in range(0, len(f), batch):
                part = f.iloc[a : a + batch]
                yield pd.DataFrame({key: part[key], "vec": list(fitted(np.asarray(embedder.embed_batch(part["_body"].fillna("").tolist())), embedder.dim))})

    return df.select(key, body.alias("_body")).mapInPandas(run, f"{key} {kind}, vec array<float>")


def ask(df: DataFrame, model: Model, keys: list[str], prompt: str, default: str | None = None, tries: int = 3, batch: int = 20) -> DataFrame:
    """(keys, reply): a failing batch is tried again, then takes the default, so no row is lost."""
    shape = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys) + ", reply string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for a in range(0, len(f), batch):
                part = f.iloc[a : a + batch]
                replies: list = [None] * len(part)
                for _ in range(tries):
                    try:
                        replies = list(model.complete(part[prompt].tolist()))
                        break
                    except Exception:  # noqa: BLE001 - whatever the outside model raises
                        continue
                yield part[keys].assign(reply=[default if r is None else r for r in replies])

    return df.select(*keys, prompt).mapInPandas(run, shape)


class Registry:
    """Retrievers by name, custom scorers, an optional reranker; ``scores`` is the sparse table of all components."""

    def __init__(self) -> None:
        self.retrievers: dict[str, Retriever] = {}
        self.custom: dict[str, Column] = {}
        self.reranker: Callable[[DataFrame], DataFrame] | None = None

    def add_retriever(self, retriever: Retriever) -> None:
        self.retrievers[retriever.name] = retriever

    def add_scorer(self, name: str, column: Column) -> None:
        """A column over the score table that is added to the final score."""
        self.custom[name] = column

    def set_reranker(self, reranker: Callable[[DataFrame], DataFrame] | None) -> None:
        self.reranker = reranker

    def scores(self, candidates: DataFrame, profiles: DataFrame) -> DataFrame:
        out = None
        for name, r in self.retrievers.items():
            part = r.score(candidates, profiles).select("profile_id", "item_id", F.col("score").alias(name))
            out = part if out is None else out.join(part, ["profile_id", "item_id"], "full")
        if out is None:
            raise ValueError("no retriever is registered")
        return out

    def rank(self, candidates: DataFrame, profiles: DataFrame, weights: dict[str, float], top: int = 20, least: float | None = None) -> DataFrame:
        rows = self.scores(candidates, profiles).join(candidates.select("item_id", "seq"), "item_id")
        out = scoring.ranked(scoring.fused(rows, weights, self.custom), top, least)
        return self.reranker(out) if self.reranker else out
