"""Where a model would be called: a protocol and deterministic stand-ins, so that plans run and can be tested."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Scorer = Callable[[pd.Series, pd.Series], pd.Series]


def hashed_embedding(dimension: int = 64) -> Callable[[Column], Column]:
    """Feature hashing of words into unit vectors: a stand-in for an embedding model."""

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        import xxhash

        def one(t: str | None) -> list[float]:
            v = np.zeros(dimension)
            for w in (t or "").lower().split():
                h = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
                v[h % dimension] += 1 if h >> 63 else -1
            n = np.linalg.norm(v)
            return (v / n if n else v).tolist()

        return texts.map(one)

    return embed


def lexical(a: pd.Series, b: pd.Series) -> pd.Series:
    """Word-set similarity: a stand-in for a cross-encoder or an entailment model."""

    def one(x: str | None, y: str | None) -> float:
        p, q = set((x or "").lower().split()), set((y or "").lower().split())
        return len(p & q) / len(p | q) if p | q else 0.0

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


def scored(scorer: Scorer = lexical) -> Callable[[Column, Column], Column]:
    """A vectorised column function of two texts from any scorer."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return scorer(a, b)

    return run
