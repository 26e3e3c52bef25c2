"""Embeddings of symbol texts through a provider that a cluster can reach; offline, a hashing one or none."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.sources.walk import upsert

#: A provider turns a list of texts into as many vectors; it runs on the executors.
Provider = Callable[[list[str]], list[list[float]]]


def hashing(dims: int = 64) -> Provider:
    """Unit vectors of signed word hashes: no model, the same everywhere."""

    def run(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = np.zeros(dims)
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                v[h % dims] += 1 if h >> 63 else -1
            norm = np.linalg.norm(v)
            out.append((v / norm if norm else v).tolist())
        return out

    return run


def embed(rows: DataFrame, provider: Provider | None, batch: int = 64) -> DataFrame:
    """rows(id, text) with embedding and error; where the provider fails for a batch its rows have a null embedding and say why. Without a provider there are no rows."""
    if provider is None:
        return rows.limit(0).select("id").withColumn("embedding", F.lit(None).cast("array<float>")).withColumn("error", F.lit(None).cast("string"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lo in range(0, len(frame), batch):
                part = frame.iloc[lo : lo + batch]
                try:
                    found, error = [np.asarray(v, np.float32) for v in provider([t or "" for t in part["text"]])], None
                    if len(found) != len(part):
                        raise ValueError(f"{len(found)} vectors for {len(part)} texts")
                except (OSError, ValueError) as e:  # the next run tries again
                    found, error = [None] * len(part), f"{type(e).__name__}: {e}"[:200]
                yield pd.DataFrame({"id": part["id"].to_numpy(), "embedding": found, "error": [error] * len(part)})

    return rows.select("id", "text").mapInPandas(run, "id long, embedding array<float>, error string")


def refresh(stored: DataFrame, rows: DataFrame, provider: Provider | None) -> DataFrame:
    """The stored embeddings (id, embedding) with those of ``rows`` anew; where the provider failed the stored ones stay."""
    return upsert(stored.select("id", "embedding"), embed(rows, provider).where("error is null").select("id", "embedding"), "id")
