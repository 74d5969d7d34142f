"""Vectors: the hashing encoder, normalising, products."""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from korpusline.functions.text import col

#: Length of the encoder's vectors.
DIM = 64
TOKEN = re.compile(r"[a-zA-Zа-яА-Я0-9]+")


@functools.lru_cache(1 << 18)
def bucket(token: str, dim: int = DIM) -> int:
    """The place of a token: the first 32 bits of its md5, modulo the length."""
    return int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % dim


def encode_batch(texts, dim: int = DIM) -> np.ndarray:
    """Counts of the tokens' places, one row per text, scaled to length 1; zeros for a null or empty text."""
    out = np.zeros((len(texts), dim))
    for row, text in enumerate(texts):
        if text:
            own = [bucket(t, dim) for t in TOKEN.findall(text.lower().replace("ё", "е"))]
            out[row] = np.bincount(own, minlength=dim) if own else 0
    return out / (np.sqrt((out * out).sum(axis=1, keepdims=True)) + 1e-12)


@functools.lru_cache
def _encoder(dim: int):
    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(list(encode_batch(texts.tolist(), dim)))

    return run


def encode(c: str | Column, dim: int = DIM) -> Column:
    """The vector of a text, in Arrow batches: a deterministic stand-in where a neural encoder plugs in."""
    return _encoder(dim)(col(c))


def norm(v: str | Column) -> Column:
    return F.sqrt(F.aggregate(col(v), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2(v: str | Column) -> Column:
    bound = F.array(F.struct(col(v).alias("v"), (norm(v) + F.lit(1e-12)).alias("n")))  # the norm is computed once
    return F.transform(bound, lambda s: F.transform(s["v"], lambda x: x.cast("double") / s["n"]))[0]


def dot(a: str | Column, b: str | Column) -> Column:
    """Left to right, in doubles."""
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def minmax(value: Column, low: Column, high: Column) -> Column:
    """Scaled to 0..1; all zeros where the range is below 1e-8."""
    return F.when(high - low < 1e-8, 0.0).otherwise((value - low) / (high - low))
