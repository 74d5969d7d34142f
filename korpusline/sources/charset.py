"""Bytes to text: the first encoding of a list that fits, as a batched function."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

# Encodings in order of trial.
ENCODINGS = ("utf-8-sig", "utf-8", "cp1251", "latin-1")


def decode_best(content: bytes | None) -> tuple[str | None, str | None]:
    """(text, encoding); null content gives nulls. The last encoding fits any bytes."""
    if content is None:
        return None, None
    for name in ENCODINGS:
        if name == "utf-8-sig" and not content.startswith(b"\xef\xbb\xbf"):
            continue
        try:
            return content.decode(name), name
        except UnicodeDecodeError:
            continue
    return content.decode("latin-1"), "latin-1"


def decoded():
    """An Arrow-batched function binary -> struct<text, encoding>."""

    @F.pandas_udf("text string, encoding string")
    def run(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([decode_best(None if x is None else bytes(x)) for x in content], columns=["text", "encoding"])

    return run
