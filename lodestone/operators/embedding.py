"""Embedding of pending chunks through a pluggable embedder, with bisection of failing batches and recorded drop reasons."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.runtime import spread
from lodestone.schema import DEFAULT

#: What an embedder is: texts in, one vector per text out; raises for a batch it can't take.
Embedder = Callable[[list[str]], np.ndarray]


class ContextExceeded(ValueError):
    """A text is too long for the embedder."""


class HashEmbedder:
    """Deterministic stand-in without a model: signed hashed words, normalised."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def __call__(self, texts: list[str]) -> np.ndarray:
        import xxhash

        out = np.zeros((len(texts), self.dim))
        for k, text in enumerate(texts):
            for w in text.lower().split():
                h = xxhash.xxh3_64_intdigest(w)
                out[k, h % self.dim] += 1 if h >> 63 else -1
        norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return out / np.where(norm > 0, norm, 1)


def embed_pairs(pairs: list[tuple[str, str]], embedder: Embedder, shrink: float = 0.88, tries: int = 6) -> list[tuple[str, np.ndarray | None, str | None]]:
    """(id, vector, drop_reason) of each pair: a failing batch is halved until single texts fail, an overlong text is cut and tried again."""
    if not pairs:
        return []
    try:
        return [(i, v, None) for (i, _), v in zip(pairs, embedder([t for _, t in pairs]))]
    except Exception as why:
        if len(pairs) > 1:
            half = len(pairs) // 2
            return embed_pairs(pairs[:half], embedder, shrink, tries) + embed_pairs(pairs[half:], embedder, shrink, tries)
        ident, text = pairs[0]
        for _ in range(tries if isinstance(why, ContextExceeded) else 0):
            text = text[: int(len(text) * shrink)]
            try:
                return [(ident, embedder([text])[0], None)]
            except ContextExceeded:
                continue
            except Exception as other:
                why = other
                break
        return [(ident, None, f"{type(why).__name__}: {why}"[:200])]


class Failover:
    """Embedders in order: one that fails rests for `rest` seconds while the next serves; the last never rests. State is the worker's own.

    A text that is too long says nothing of an embedder's health: the next ones, which may take more, are tried, and it is raised at the end.
    """

    def __init__(self, *embedders: Embedder, rest: float = 1800.0, clock: Callable[[], float] = time.monotonic):
        self.embedders, self.rest, self.clock, self.until = embedders, rest, clock, [float("-inf")] * len(embedders)

    def __call__(self, texts: list[str]) -> np.ndarray:
        too_long: ContextExceeded | None = None
        last: Exception | None = None
        for k, embedder in enumerate(self.embedders):
            if self.clock() < self.until[k] and k < len(self.embedders) - 1:
                continue
            try:
                out = embedder(texts)
                self.until[k] = float("-inf")
                return out
            except ContextExceeded as why:
                too_long = why
            except Exception as why:
                self.until[k], last = self.clock() + self.rest, why
        raise too_long or last or RuntimeError("no embedder")


class HttpEmbedder:
    """An endpoint that takes {"input": [texts]} and gives {"data": [{"index", "embedding"}]}; the first `dim` numbers count."""

    def __init__(self, url: str, dim: int, timeout: float = 45.0, model: str | None = None):
        self.url, self.dim, self.timeout, self.model = url, dim, timeout, model

    def __call__(self, texts: list[str]) -> np.ndarray:
        body = {"input": texts} | ({"model": self.model} if self.model else {})
        call = urllib.request.Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(call, timeout=self.timeout) as answer:
                data = sorted(json.load(answer)["data"], key=lambda d: d["index"])
        except urllib.error.HTTPError as why:
            said = why.read().decode("utf-8", "replace")
            raise (ContextExceeded if "context" in said.lower() or "too large" in said.lower() else RuntimeError)(said[:200]) from why
        return np.array([d["embedding"][: self.dim] for d in data], dtype=np.float64)


def query_text(q: Column, task: str = "Given a search query, retrieve the passages that answer it") -> Column:
    """What is embedded for a query: the task before it, as models that take instructions expect; texts are embedded as they are."""
    return F.format_string("Instruct: %s\nQuery: %s", F.lit(task), q)


def embed(pending: DataFrame, embedder: Embedder | None = None, batch: int = 64, head: int = DEFAULT.embed_head, digits: int = 6) -> DataFrame:
    """(id, embedding, drop_reason) of pending rows (id, text): vectors of the texts' first `head` characters, rounded as stored."""
    made = embedder or HashEmbedder()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            pairs = list(zip(b["id"], b["text"]))
            rows = [r for at in range(0, len(pairs), batch) for r in embed_pairs(pairs[at : at + batch], made)]
            yield pd.DataFrame({"id": [r[0] for r in rows], "embedding": [None if r[1] is None else np.round(r[1], digits).astype(np.float32) for r in rows], "drop_reason": [r[2] for r in rows]})

    rows = pending.where(F.col("id").isNotNull()).select("id", F.substring(F.coalesce("text", F.lit("")), 1, head).alias("text"))
    return spread(rows).mapInPandas(run, "id string, embedding array<float>, drop_reason string")


def throughput(pending: DataFrame, embedder: Embedder | None = None, configs: tuple[tuple[int, int], ...] = ((8, 8), (16, 8), (8, 16), (24, 8), (16, 16)), rows: int = 2000) -> list[dict]:
    """Measured rate of each (workers, batch) over the first `rows` pending texts by id: texts, seconds, texts a second."""
    sample = pending.orderBy("id").limit(rows).toPandas()
    out = []
    for workers, batch in configs:
        df = pending.sparkSession.createDataFrame(sample).repartition(workers)
        start = time.perf_counter()
        n = embed(df, embedder, batch).where("embedding is not null").count()
        spent = time.perf_counter() - start
        out.append({"workers": workers, "batch": batch, "texts": n, "seconds": round(spent, 3), "rate": round(n / spent, 1)})
    return out
