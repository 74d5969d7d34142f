"""Documents from elements: grouping, heading and path texts, the document-frequency lexicon."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpusline.functions import text as tx
from korpusline.functions import vectors as vc


def keyed(rows: DataFrame) -> DataFrame:
    """Rows with their doc_key, each id once."""
    return rows.withColumn("doc_key", tx.doc_key()).dropDuplicates(["id"])


def documents_of(elements: DataFrame) -> DataFrame:
    """(doc_key, elements, first_page, last_page, chars): one row per document, in one aggregation."""
    return keyed(elements.select("id", "category", "doc_id", "doc_path", "page", "text")).groupBy("doc_key").agg(
        F.count(F.lit(1)).alias("elements"), F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")
    )


def heading_texts(elements: DataFrame) -> DataFrame:
    """(doc_key, heading_text): the distinct headings of a document, by first occurrence.

    Distinct headings are found before they are collected, so a document with a third of all rows gives
    a list as long as its headings, not its rows.
    """
    rows = keyed(elements.select("id", "category", "doc_id", "doc_path", "page", "elem_order", "headings_path"))
    place = F.struct(F.coalesce("page", F.lit(0)), F.coalesce("elem_order", F.lit(0)), "id", "pos")
    heads = rows.select("doc_key", "id", "page", "elem_order", F.posexplode("headings_path").alias("pos", "heading")).withColumn("heading", tx.squeeze("heading")).filter("heading <> ''")
    first = heads.groupBy("doc_key", "heading").agg(F.min(place).alias("at"))
    listed = first.groupBy("doc_key").agg(F.array_sort(F.collect_list(F.struct("at", "heading"))).alias("all"))
    return listed.select("doc_key", F.array_join(F.transform("all", lambda x: x["heading"]), " ").alias("heading_text"))


def doc_fields(elements: DataFrame) -> DataFrame:
    """(doc_key, category, doc_id, doc_path, heading_text, path_text, nav_tokens, heading_vec, path_vec, category_vec)."""
    docs = elements.withColumn("doc_key", tx.doc_key()).groupBy("doc_key").agg(F.min("category").alias("category"), F.min("doc_id").alias("doc_id"), F.min("doc_path").alias("doc_path"))
    full = docs.join(heading_texts(elements), "doc_key", "left").withColumn("heading_text", F.coalesce("heading_text", F.lit(""))).withColumn("path_text", tx.path_text("doc_path"))
    return full.select("*", nav_tokens("path_text", "heading_text").alias("nav_tokens"), vc.encode("heading_text").alias("heading_vec"), vc.encode("path_text").alias("path_vec"), vc.encode("category").alias("category_vec"))


def nav_tokens(path_text: str = "path_text", heading_text: str = "heading_text"):
    """The tokens a document is found by: those of its path and its headings."""
    return tx.tokens(F.concat_ws(" ", path_text, heading_text))


def lexicon(fields: DataFrame) -> DataFrame:
    """(token, df): in how many documents a token occurs."""
    return fields.select(F.explode(F.array_distinct(nav_tokens())).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
