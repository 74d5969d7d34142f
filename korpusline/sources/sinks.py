"""Sinks: JSON lines, Parquet, and batched upserts into an external vector store."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_jsonl(rows: DataFrame, path: str) -> None:
    """One JSON object per row; characters are kept as they are."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_parquet(rows: DataFrame, path: str, *partitions: str) -> None:
    (rows.write.partitionBy(*partitions) if partitions else rows.write).mode("overwrite").parquet(path)


def attributes(rows: DataFrame, *names: str) -> Column:
    """Attributes as one JSON text: nulls dropped, nested values as JSON."""
    return F.to_json(F.struct(*[F.col(n) for n in names]), {"ignoreNullFields": "true"})


def upsert(rows: DataFrame, connect: Callable[[], object], batch: int = 256, required: bool = False) -> bool:
    """Writes rows in batches through a client with ping() and upsert(list of dicts); keyed by id, so a repeated task does no harm.

    Where the store does not answer, nothing is written: an error if it is required, else False.
    """
    try:
        connect().ping()
    except Exception:
        if required:
            raise
        return False

    def send(part: Iterator) -> None:
        client, waiting = connect(), []
        for row in part:
            waiting.append(row.asDict(recursive=True))
            if len(waiting) == batch:
                client.upsert(waiting)
                waiting = []
        if waiting:
            client.upsert(waiting)

    rows.foreachPartition(send)
    return True
