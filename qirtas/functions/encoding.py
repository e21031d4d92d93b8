"""Encoders: texts to vectors. Neural models are plugged in; an offline stand-in makes every path runnable."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ModelConfig:
    """What an encoder needs to know. Variants of reduced precision share `name`, hence stored vectors, with the full model."""

    model_id: str
    name: str
    dimension: int = 768
    query_prompt: str | None = None
    doc_prompt: str | None = None
    batch_size: int = 32
    device: str = "cpu"
    local_path: str | None = None

    def __post_init__(self) -> None:
        if self.dimension <= 0:
            raise ValueError("dimension must be positive")
        if self.batch_size <= 0:
            raise ValueError("batch_size must be positive")

    @property
    def label(self) -> str:
        return f"vector-basic-{self.name}" + ("-int8" if self.local_path else "")


class Encoder(ABC):
    """Texts to unit vectors (n, dimension), float32. Made once a task, from a configuration that is sent to it."""

    config: ModelConfig

    @abstractmethod
    def encode(self, texts: list[str], prompt: str | None = None) -> np.ndarray: ...


class HashingEncoder(Encoder):
    """Offline stand-in: signed counts of words and of their trigrams at hashed positions. No equivalent of a neural model."""

    def __init__(self, config: ModelConfig):
        self.config = config

    def encode(self, texts: list[str], prompt: str | None = None) -> np.ndarray:
        out = np.zeros((len(texts), self.config.dimension), dtype=np.float32)
        for row, text in zip(out, texts):
            for word in text.lower().split():
                for part in (word, *(word[k : k + 3] for k in range(len(word) - 2))):
                    h = xxhash.xxh3_64_intdigest(part)
                    row[h % self.config.dimension] += 1.0 if h >> 63 else -1.0
        norm = np.sqrt((out**2).sum(1, keepdims=True))
        return out / np.where(norm > 0, norm, 1)


Factory = Callable[[ModelConfig], Encoder]

#: Configurations by name; the identifiers are those of the public models, which are not part of this repository.
MODELS = {
    "gemma": ModelConfig("google/embeddinggemma-300M", "gemma-300M", 768, "Retrieval-query", "Retrieval-document"),
    "gemma-int8": ModelConfig("google/embeddinggemma-300M", "gemma-300M", 768, "Retrieval-query", "Retrieval-document", local_path="models/gemma-300M-int8"),
}


def load(config: ModelConfig, local: Factory | None, hub: Factory) -> Encoder:
    """The local model where the configuration names one and it loads, else the one from the hub; its configuration then has
    no local path. Configurations are never changed in place."""
    if config.local_path and local is not None:
        try:
            return local(config)
        except (OSError, RuntimeError, ValueError):
            pass
    return hub(replace(config, local_path=None))


def encode(df: DataFrame, text_col: str, config: ModelConfig, factory: Factory = HashingEncoder, query: bool = False, out_col: str = "embedding") -> DataFrame:
    """The rows with `embedding` of a text, by Arrow batches cut to the model's batch size; null for a null text."""
    prompt = config.query_prompt if query else config.doc_prompt

    def run(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = factory(config)
        for v in values:
            out: list[list[float] | None] = [None] * len(v)
            at = [i for i, x in enumerate(v) if isinstance(x, str)]
            for low in range(0, len(at), config.batch_size):
                part = at[low : low + config.batch_size]
                for i, row in zip(part, encoder.encode([v.iloc[j] for j in part], prompt)):
                    out[i] = row.tolist()
            yield pd.Series(out, dtype=object)

    return df.withColumn(out_col, F.pandas_udf(run, "array<float>")(F.col(text_col)))
