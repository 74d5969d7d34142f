"""Rows of databases and tables as elements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korpusline.functions import text as tx


def row_elements(rows: DataFrame, category: str | None = None) -> DataFrame:
    """One element per row: with exactly three columns `second\\nthird`, else all columns joined by ` | `; doc_id is the first column."""
    names = rows.columns
    text = F.concat_ws("\n", *[F.col(c).cast("string") for c in names[1:]]) if len(names) == 3 else F.concat_ws(" | ", *[F.col(c).cast("string") for c in names])
    return rows.select(F.lit(category).alias("category"), F.lit("postgres").alias("doc_path"), F.col(names[0]).cast("string").alias("doc_id"), F.lit("pg").alias("source_type"), F.lit("row").alias("element_type"), text.alias("text"))


def named_rows(rows: DataFrame) -> DataFrame:
    """One text per row: `column: value; …`, nulls left out."""
    return rows.select(tx.row_text({c: c for c in rows.columns}).alias("text"))


def jdbc(spark: SparkSession, url: str, query: str, category: str | None = None, **options: str) -> DataFrame:
    """Elements of a query on a database; options such as partitionColumn and numPartitions spread the read."""
    return row_elements(spark.read.format("jdbc").options(url=url, query=query, **options).load(), category)
