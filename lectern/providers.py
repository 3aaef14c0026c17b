"""Models behind interfaces: embedders, rerankers and chat models, with local stand-ins.

The stand-ins are deterministic and need no network; they make no claim to match any real model.
"""

from __future__ import annotations

import math
import time
import zlib
from collections import OrderedDict
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import ship_package


class Embedder(Protocol):
    def embed_documents(self, texts: list[str]) -> list[list[float]]: ...

    def embed_query(self, text: str) -> list[float]: ...


class Reranker(Protocol):
    def __call__(self, pairs: list[tuple[str, str]]) -> list[float]: ...


class ChatModel(Protocol):
    def stream(self, system: str, prompt: str, images: list[dict] | None = None) -> Iterator[str]: ...


class HashedEmbedder:
    """Stand-in: counts of hashed pairs of characters, as unit vectors."""

    def __init__(self, dimensions: int = 256):
        self.dimensions = dimensions

    def embed_query(self, text: str) -> list[float]:
        s = text.strip().lower()
        v = np.zeros(self.dimensions)
        for pair in [s[i : i + 2] for i in range(max(len(s) - 1, 1))] if s else []:
            h = zlib.crc32(pair.encode("utf-8", "surrogatepass"))
            v[h % self.dimensions] += 1.0 if h >> 31 else -1.0
        norm = math.sqrt(float(v @ v))
        return (v / norm if norm else v).tolist()

    def embed_documents(self, texts: list[str]) -> list[list[float]]:
        return [self.embed_query(t) for t in texts]


class OverlapReranker:
    """Stand-in: the share of the query's character pairs that a passage holds."""

    def __call__(self, pairs: list[tuple[str, str]]) -> list[float]:
        out = []
        for query, passage in pairs:
            grams = {query[i : i + 2] for i in range(max(len(query) - 1, 1))}
            out.append(sum(g in passage for g in grams) / max(len(grams), 1))
        return out


class ExtractiveChat:
    """Stand-in: answers with the first lines of content in the prompt."""

    def stream(self, system: str, prompt: str, images: list[dict] | None = None) -> Iterator[str]:
        found = [part.split("\n---", 1)[0].strip() for part in prompt.split("内容:\n")[1:]]
        for part in found[:2] or ["平台使用指南中未找到相关信息"]:
            yield part[:200] + "\n"


def is_throttled(error: Exception) -> bool:
    """Whether an error says that too many requests were sent."""
    said = str(error).lower()
    return getattr(error, "status_code", None) == 429 or "429" in said or "rate limit" in said or "限流" in said


def with_retries(call: Callable[[], object], attempts: int = 8, base: float = 2.0, retry: Callable[[Exception], bool] = is_throttled, sleep: Callable[[float], None] = time.sleep) -> object:
    """call(), again after base * 2**k seconds for errors that retry() accepts."""
    for k in range(attempts):
        try:
            return call()
        except Exception as e:
            if k == attempts - 1 or not retry(e):
                raise
            sleep(base * 2**k)
    raise ValueError("attempts must be positive")


class CachedEmbedder:
    """An embedder that keeps the vectors of its last queries; the oldest goes first."""

    def __init__(self, inner: Embedder, model: str = "", size: int = 256):
        self.inner, self.model, self.size = inner, model, size
        self._kept: OrderedDict[str, list[float]] = OrderedDict()

    def embed_documents(self, texts: list[str]) -> list[list[float]]:
        return self.inner.embed_documents(texts)

    def embed_query(self, text: str) -> list[float]:
        key = f"{self.model}:{text}"
        if key not in self._kept:
            vector = self.inner.embed_query(text)
            if self.size <= 0:
                return vector
            while len(self._kept) >= self.size:
                self._kept.popitem(last=False)
            self._kept[key] = vector
        return self._kept[key]


def embed(rows: DataFrame, key: str, text: str, client: Callable[[], Embedder], to: str = "embedding", batch: int = 16, attempts: int = 8, base: float = 2.0) -> DataFrame:
    """(key, to): each row's text embedded in batches; equal texts are sent once; an empty vector is an error."""
    ship_package(rows.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = client()
        for part in parts:
            texts, vectors = part["t"].tolist(), []
            for at in range(0, len(texts), batch):
                some = texts[at : at + batch]
                vectors += with_retries(lambda some=some: model.embed_documents(some), attempts, base, retry=lambda e: True)
            if any(len(v) == 0 for v in vectors):
                raise ValueError("a model returned an empty vector")
            yield pd.DataFrame({"t": texts, "v": vectors})

    once = rows.select(F.coalesce(text, F.lit("")).alias("t")).distinct().mapInPandas(run, "t string, v array<float>")
    return rows.select(F.col(key), F.coalesce(text, F.lit("")).alias("t")).join(once, "t").select(key, F.col("v").alias(to))


def chat_once(model: ChatModel, system: str, prompt: str, images: list[dict] | None = None) -> str:
    return "".join(chat_stream(model, system, prompt, images))


def chat_stream(model: ChatModel, system: str, prompt: str, images: list[dict] | None = None) -> Iterator[str]:
    """A model's answer; if it fails with images before it said anything, without them; then the error is the answer."""
    for shown in ([images, None] if images else [None]):
        said = False
        try:
            for part in model.stream(system, prompt, shown):
                said = True
                yield part
            return
        except Exception as e:
            if said or shown is None:
                yield f"Error: {e}"
                return
