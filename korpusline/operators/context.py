"""Contexts for a prompt: token-budgeted packing by section, rendering, citations, coverage and quality.

What is folded is the packed list of one query, bounded by the reranker's limits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korpusline.config import ContextConfig
from korpusline.functions import text as tx


def items(hits: DataFrame) -> DataFrame:
    """Hits with section, level, full text, tokens and the packing order: large sections first, then by score."""
    own = hits.withColumn("section", tx.section_id("heading_path")).withColumn("level", tx.hierarchy_level("heading_path"))
    path = F.array_join(F.coalesce("heading_path", F.array().cast("array<string>")), " > ")
    body = own.withColumn("full", F.when(path != "", F.concat(path, F.lit("\n"), "text")).otherwise(F.col("text"))).withColumn("tokens", tx.token_count("full"))
    size = F.count(F.lit(1)).over(Window.partitionBy("query_id", "section"))
    return body.withColumn("section_size", size).withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("section_size"), "section", F.desc("score"), "id")))


def pack(placed: DataFrame, cfg: ContextConfig = ContextConfig()) -> DataFrame:
    """(query_id, place, section, text, tokens) of the items that fit the budget, in packing order.

    An item over the remaining budget is cut to whole sentences and taken if it then fits. A section
    gives at most cfg.items_per_section items.
    """
    lists = placed.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "section", "full", "tokens"))).alias("all"))
    kept = "array<struct<place:int,section:string,text:string,tokens:int>>"
    zero = F.struct(F.lit(cfg.token_budget).alias("left"), F.array().cast(kept).alias("out"))

    def shortened(text: Column, left: Column) -> Column:
        parts = F.filter(F.transform(F.split(text, r"[.!?]+"), lambda x: F.trim(x)), lambda x: x != "")
        fold = F.aggregate(
            parts,
            F.struct(F.lit("").alias("t"), F.lit(False).alias("full")),
            lambda a, s: F.when(a["full"] | (tx.token_count(F.concat(a["t"], s, F.lit(". "))) > left), F.struct(a["t"].alias("t"), F.lit(True).alias("full"))).otherwise(F.struct(F.concat(a["t"], s, F.lit(". ")).alias("t"), F.lit(False).alias("full"))),
            lambda a: F.trim(a["t"]),
        )
        return F.when(fold == "", F.substring(text, F.lit(1), F.greatest(left, F.lit(0)) * 4)).otherwise(fold)

    def step(acc: Column, x: Column) -> Column:
        used = F.size(F.filter(acc["out"], lambda o: o["section"] == x["section"]))
        text = F.when(x["tokens"] <= acc["left"], x["full"]).otherwise(shortened(x["full"], acc["left"]))
        size = tx.token_count(text)
        fits = (used < cfg.items_per_section) & (acc["left"] > 0) & (F.length(text) > 0) & (size <= acc["left"])
        one = F.struct(x["place"].cast("int").alias("place"), x["section"].alias("section"), text.alias("text"), size.alias("tokens"))
        return F.when(fits, F.struct((acc["left"] - size).cast("int").alias("left"), F.concat(acc["out"], F.array(one)).cast(kept).alias("out"))).otherwise(acc)

    return lists.select("query_id", F.explode(F.aggregate("all", zero, step)["out"]).alias("x")).select("query_id", "x.place", "x.section", "x.text", "x.tokens")


def prompt(packed: DataFrame) -> DataFrame:
    """(query_id, prompt): sections in alphabetical order under their headers."""
    sections = packed.groupBy("query_id", "section").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("all"))
    block = sections.withColumn("block", F.concat(F.lit("=== Раздел: "), "section", F.lit(" ===\n"), F.array_join(F.transform("all", lambda x: x["text"]), "\n\n---\n\n")))
    return block.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "block"))), lambda x: x["block"]), "\n\n").alias("prompt"))


def citations(packed: DataFrame, placed: DataFrame) -> DataFrame:
    """(query_id, place, citation) of the packed items."""
    return packed.select("query_id", "place").join(placed, ["query_id", "place"]).select("query_id", "place", tx.citation("category", "doc_path", "page_from", "page_to").alias("citation"))


def coverage(rows: DataFrame) -> DataFrame:
    """(query_id, kind, value, items): items by category, by section and by level, in one pass."""
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.coalesce(F.col(c).cast("string"), F.lit("UNK")).alias("value")) for k, c in (("category", "category"), ("section", "section"), ("level", "level"))])).alias("x")
    return rows.select("query_id", kinds).groupBy("query_id", "x.kind", "x.value").agg(F.count(F.lit(1)).alias("items"))


def quality(rows: DataFrame) -> DataFrame:
    """(query_id, documents, levels, category_diversity, mean_score, items)."""
    with_category = F.count_if(F.coalesce(F.col("category"), F.lit("")) != "")
    diversity = F.when(with_category == 0, 0.0).otherwise(F.count_distinct("category") / with_category)
    return rows.groupBy("query_id").agg(F.count_distinct("doc_key").alias("documents"), F.count_distinct("level").alias("levels"), F.round(diversity, 6).alias("category_diversity"), F.round(F.avg("score"), 4).alias("mean_score"), F.count(F.lit(1)).alias("items"))


def summary(rows: DataFrame) -> DataFrame:
    """(query_id, summary): per category its sections but the root, or that it is general."""
    own = rows.withColumn("category", F.coalesce(tx.filled("category"), F.lit("UNK"))).groupBy("query_id", "category").agg(F.min("place").alias("at"), F.array_sort(F.collect_set(F.when(F.col("section") != "root", F.col("section")))).alias("sections"))
    line = F.concat("category", F.lit(": "), F.when(F.size("sections") > 0, F.array_join("sections", ", ")).otherwise(F.lit("общая информация")))
    return own.withColumn("line", line).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "; ").alias("summary"))
