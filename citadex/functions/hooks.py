"""Plug-in points for models: an encoder and a pair scorer, both fed in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from citadex.functions import text as tx

Encoder = Callable[[Column], Column]
PairScorer = Callable[[Column, Column], Column]


def hashed_encoder(dim: int = 256) -> Encoder:
    """Unit vectors of hashed term counts: needs no model, so it serves tests and cold starts."""

    @F.pandas_udf("array<float>")
    def pack(buckets: pd.Series) -> pd.Series:
        def one(ids) -> np.ndarray:
            counts = np.bincount(np.asarray(ids, dtype=np.int64), minlength=dim).astype(np.float64)
            norm = np.linalg.norm(counts)
            return (counts / norm if norm else counts).astype(np.float32)

        return buckets.map(one)

    def encode(text: Column) -> Column:
        return pack(F.transform(tx.tokens(text), lambda t: F.pmod(F.xxhash64(t), F.lit(dim))))

    return encode


def model_encoder(load: Callable[[], Callable[[list[str]], np.ndarray]]) -> Encoder:
    """Wrap a model: `load` runs once per Python worker and returns texts -> matrix."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            yield pd.Series(list(np.asarray(model(batch.tolist()), dtype=np.float32)))

    return lambda text: run(text)


def model_pair_scorer(load: Callable[[], Callable[[list[str], list[str]], np.ndarray]]) -> PairScorer:
    """Wrap a cross-encoder: `load` runs once per Python worker and returns (queries, texts) -> scores."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for queries, texts in batches:
            yield pd.Series(np.asarray(model(queries.tolist(), texts.tolist()), dtype=np.float64))

    return lambda query, text: run(query, text)


def model_answerer(load: Callable[[], Callable[[list[str]], list[str]]]) -> Encoder:
    """Wrap a text generator over assembled prompts; none is shipped."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            yield pd.Series(model(batch.tolist()))

    return lambda prompt: run(prompt)


def term_coverage(query: Column, text: Column) -> Column:
    """Default pair scorer: share of the distinct query terms that the text holds."""
    return tx.let(
        F.array_distinct(tx.tokens(query)),
        lambda q: F.when(
            F.size(q) > 0, F.size(F.array_intersect(q, tx.tokens(text))) / F.size(q)
        ).otherwise(0.0),
    )
