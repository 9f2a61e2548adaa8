"""Model calls behind one interface, with a deterministic stand-in that needs no network.

Calls are marked as not deterministic, so no filter on a result is moved below the join that keeps cached rows from a call.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType

from casebench.session import written
from casebench.sources.logtable import LogTable

BATCH = 32


class ModelProvider(Protocol):
    """What the library asks of a model; implementations are pickled to the executors."""

    name: str

    def embed(self, texts: list[str]) -> list[list[float]]: ...

    def score(self, pairs: list[tuple[str, str]]) -> list[float]: ...

    def complete(self, prompts: list[str]) -> list[str]: ...


class Stub:
    """Embeds by hashed words, scores by shared words, completes with a digest of the prompt as JSON."""

    name = "stub"

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dim))
        for row, t in zip(out, texts, strict=True):
            for w in (t or "").lower().split():
                h = int.from_bytes(hashlib.sha256(w.encode()).digest()[:8], "little")
                row[h % self.dim] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm == 0, 1, norm)).tolist()

    def score(self, pairs: list[tuple[str, str]]) -> list[float]:
        return [len(a & b) / max(len(a | b), 1) for a, b in ((set((x or "").lower().split()), set((y or "").lower().split())) for x, y in pairs)]

    def complete(self, prompts: list[str]) -> list[str]:
        return [json.dumps({"label": ("met", "breached", "unclear")[hashlib.sha256((p or "").encode()).digest()[0] % 3], "confidence": "low"}) for p in prompts]


def embedded(df: DataFrame, text: str, provider: ModelProvider, out: str = "embedding") -> DataFrame:
    """df with an embedding of a column; in batches of the session's Arrow size, cut to BATCH."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([v for lo in range(0, len(s), BATCH) for v in provider.embed(s.iloc[lo : lo + BATCH].tolist())])

    return df.withColumn(out, F.pandas_udf(run, "array<double>").asNondeterministic()(F.col(text)))


def scored(df: DataFrame, query: str, text: str, provider: ModelProvider, out: str = "score") -> DataFrame:
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, t in batches:
            yield pd.Series(provider.score(list(zip(q, t, strict=True))), dtype=float)

    return df.withColumn(out, F.pandas_udf(run, "double").asNondeterministic()(F.col(query), F.col(text)))


def completed(df: DataFrame, prompt: str, provider: ModelProvider, out: str = "answer") -> DataFrame:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(provider.complete(s.tolist()))

    return df.withColumn(out, F.pandas_udf(run, StringType()).asNondeterministic()(F.col(prompt)))


def cache_key(*parts: F.Column) -> F.Column:
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def probed(work: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits with result_json, misses) of work by cache_key; of several cached results the latest counts."""
    latest = cache.groupBy("cache_key").agg(F.max_by("result_json", F.struct("created_at", "result_json")).alias("result_json"))
    return work.join(latest, "cache_key"), work.join(latest, "cache_key", "left_anti")


def through_cache(work: DataFrame, cache: DataFrame, prompt: str, provider: ModelProvider, keep: Callable[[F.Column], F.Column] = lambda r: r.isNotNull()) -> tuple[DataFrame, DataFrame]:
    """(results of all work, new cache rows): only misses reach the model, and what `keep` refuses isn't cached."""
    hits, misses = probed(work, cache)
    fresh = completed(misses, prompt, provider, "result_json")
    rows = fresh.filter(keep(F.col("result_json"))).select("cache_key", "result_json", F.current_timestamp().alias("created_at"))
    return hits.unionByName(fresh), rows


def dry_run(work: DataFrame, cache: DataFrame, prompt: str, rate_in: float, rate_out: float, out_tokens: int = 500) -> DataFrame:
    """What the misses would cost, without a call: one row of calls, tokens and dollars. A token is four characters."""
    _, misses = probed(work, cache)
    tokens = F.greatest(F.lit(1), F.floor(F.length(prompt) / 4))
    return misses.agg(F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum(tokens), F.lit(0)).alias("prompt_tokens"), F.round((F.coalesce(F.sum(tokens), F.lit(0)) * rate_in + F.count(F.lit(1)) * out_tokens * rate_out) / 1e6, 6).alias("cost_usd"))


class StoredCache:
    """A log table of verdicts by cache_key: what a model has answered is never asked again, by whichever run."""

    def __init__(self, spark: SparkSession, root: str, fan: int = 8):
        self.table = LogTable(spark, root, "cache_key string, pass_name string, subject string, result_json string", ["cache_key"], ("result_json",), fan)

    def answered(self, work: DataFrame, prompt: str, provider: ModelProvider, keep: Callable[[F.Column], F.Column] = lambda r: r.isNotNull(), whole: bool = False) -> DataFrame:
        """work (cache_key, pass_name, subject, the prompt's column) with result_json; several rows of a key cost one call.

        Misses reach the model and their answers are committed as one batch; what `keep` refuses, such as a failed call, isn't
        cached and has a null result (whole: the result as it came), so that the next run asks again.
        """
        known = self.table.read().select("cache_key", "result_json")
        asked = work.join(known, "cache_key", "left_anti").groupBy("cache_key").agg(F.min(F.struct("pass_name", "subject", prompt)).alias("r")).select("cache_key", "r.*")
        # written first: what is committed and what is handed on must be one answer
        fresh = written(completed(asked, prompt, provider, "result_json").select("cache_key", "pass_name", "subject", "result_json"), "answers")
        right = keep(F.col("result_json"))
        self.table.append(fresh.filter(right))
        found = self.table.read().select("cache_key", "result_json")
        if whole:
            found = found.unionByName(fresh.filter(~F.coalesce(right, F.lit(False))).select("cache_key", "result_json"))
        return work.join(found, "cache_key", "left")
