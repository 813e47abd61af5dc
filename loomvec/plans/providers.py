"""Embedding providers: each adds ``vector`` and ``n_tokens`` to rows of distinct texts."""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomvec.functions.text import Model
from loomvec.functions.vectors import SHADOW_DIM, with_shadow_vectors

#: Published prices in USD for a token, and that of any other model: fixed values.
PRICES = {"text-embedding-3-small": 0.02 / 1e6, "text-embedding-3-large": 0.13 / 1e6, "text-embedding-ada-002": 0.10 / 1e6}
DEFAULT_PRICE = 0.02 / 1e6
ATTEMPTS = 5


def price_table(spark: SparkSession, prices: dict[str, float] = PRICES) -> DataFrame:
    return spark.createDataFrame(sorted(prices.items()), "name string, usd_per_token double")


def price(name: Column, prices: dict[str, float] = PRICES, default: float = DEFAULT_PRICE) -> Column:
    out = F.lit(default)
    for n, p in prices.items():
        out = F.when(name == n, p).otherwise(out)
    return out


def shadow(rows: DataFrame, model: Model, batch_size: int, dim: int = SHADOW_DIM, salt: int = 0) -> DataFrame:
    """Deterministic vectors at no cost, for tests and dry runs; the model plays no part but through ``salt``."""
    return with_shadow_vectors(rows, dim, salt).withColumn("n_tokens", F.lit(0).cast("long"))


def _post(url: str, key: str, body: dict) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {key}"})
    with urllib.request.urlopen(request, timeout=120) as answer:
        return json.load(answer)


def embed_batch(texts: list[str], name: str, url: str, key: str, post: Callable = _post, sleep: Callable = time.sleep) -> tuple[list[list[float]], int]:
    """Vectors in the order of the texts, and the tokens billed; waits 1, 2, 4 and 8 seconds when the server limits the rate."""
    for attempt in range(ATTEMPTS):
        try:
            answer = post(url, key, {"model": name, "input": texts})
            break
        except urllib.error.HTTPError as e:
            if e.code != 429 or attempt == ATTEMPTS - 1:
                raise
            sleep(2**attempt)
    data = sorted(answer["data"], key=lambda d: d["index"])
    return [d["embedding"] for d in data], int(answer["usage"]["total_tokens"])


def openai(rows: DataFrame, model: Model, batch_size: int, url: str | None = None) -> DataFrame:
    """Vectors from an API of the widely copied form; tokens come back as a column, as retried tasks would count accumulators twice."""
    key = os.environ.get("OPENAI_API_KEY")
    if not key:
        raise ValueError("OPENAI_API_KEY is not set")
    at = url or os.environ.get("OPENAI_BASE_URL", "https://api.openai.com/v1") + "/embeddings"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, batch_size):
                b = whole.slice(start, batch_size)
                vectors, tokens = embed_batch(b.column("source_text").to_pylist(), model.name, at, key)
                counted = [tokens, *[0] * (b.num_rows - 1)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([np.asarray(v, np.float32) for v in vectors], pa.list_(pa.float32())), pa.array(counted, pa.int64())], names=[*b.schema.names, "vector", "n_tokens"])

    return rows.mapInArrow(run, rows.select("*", F.array(F.lit(0.0).cast("float")).alias("vector"), F.lit(0).cast("long").alias("n_tokens")).schema)


PROVIDERS: dict[str, Callable[..., DataFrame]] = {"openai": openai, "shadow": shadow}


def provider(model: Model, shadow_mode: bool = False) -> Callable[..., DataFrame]:
    if shadow_mode:
        return shadow
    if model.provider not in PROVIDERS:
        raise ValueError(f"no provider {model.provider!r}; there are {', '.join(sorted(PROVIDERS))}")
    return PROVIDERS[model.provider]
