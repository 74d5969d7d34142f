"""Reranking of hits: cosine, cross and hybrid scores, hierarchy and page coherence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korpusline.config import RerankConfig
from korpusline.functions import text as tx
from korpusline.functions import vectors as vc
from korpusline.functions.session import cut

BY = ["query_id", "doc_key"]


def overlap_score(query: str = "query", text: str = "text") -> Column:
    """The default pair scorer, in place of a neural model: share of the query's tokens in the text."""
    asked = F.array_distinct(tx.tokens(query))
    return F.when(F.size(asked) == 0, 0.0).otherwise(F.size(F.array_intersect(asked, tx.tokens(text))) / F.size(asked))


def hierarchy_score(hits: DataFrame) -> DataFrame:
    """(query_id, doc_key, hierarchy): 0.8 / (1 + 0.1 * depth) of each hit with a path, over 0.8 * hits (1 at least)."""
    depth = F.coalesce(F.size("heading_path"), F.lit(0))
    part = F.when(F.coalesce(F.size("heading_path"), F.lit(0)) > 0, 0.8 / (1 + 0.1 * depth)).otherwise(0.0)
    return hits.groupBy(*BY).agg(F.round(F.sum(part) / F.greatest(0.8 * F.count(F.lit(1)), F.lit(1.0)), 9).alias("hierarchy"))


def coherence(hits: DataFrame, cfg: RerankConfig = RerankConfig()) -> DataFrame:
    """(query_id, doc_key, coherence): share of neighbouring pages with a gap of at most max_page_gap; 0 below two pages."""
    w = Window.partitionBy(*BY).orderBy("page_from")
    gaps = hits.filter("page_from is not null").withColumn("gap", F.col("page_from") - F.lag("page_from").over(w))
    near = F.avg(F.when(F.col("gap") <= cfg.max_page_gap, 1.0).when(F.col("gap").isNotNull(), 0.0))
    return gaps.groupBy(*BY).agg(F.round(F.coalesce(near, F.lit(0.0)), 9).alias("coherence"))


def hit_scores(hits: DataFrame, cfg: RerankConfig = RerankConfig(), pair_score: Column | None = None) -> DataFrame:
    """hits (query_id, query, doc_key, id, text, heading_path, page_from, score) with `final`.

    kind `none` keeps the score; `cosine` and `cross_encoder` take one of the two; `hybrid` scales both within
    the document and mixes them with cfg.alpha. final = 0.6 * s + 0.3 * hierarchy + 0.1 * coherence of the document.
    """
    cosine = F.round(vc.dot(vc.encode(tx.cut_tokens("text")), vc.encode("query")), 9)
    pair = F.round(pair_score if pair_score is not None else overlap_score(), 9)
    w = Window.partitionBy(*BY)
    both = hits.withColumn("cosine", cosine).withColumn("cross", pair)

    def scaled(c: str) -> Column:
        return vc.minmax(F.col(c), F.min(c).over(w), F.max(c).over(w))

    mixed = {"none": F.col("score"), "cosine": F.col("cosine"), "cross_encoder": F.col("cross"), "hybrid": cfg.alpha * scaled("cross") + (1 - cfg.alpha) * scaled("cosine")}[cfg.kind]
    full = both.withColumn("own", mixed).join(hierarchy_score(hits), BY).join(coherence(hits, cfg), BY, "left").withColumn("coherence", F.coalesce("coherence", F.lit(0.0)))
    return full.withColumn("final", F.round(0.6 * F.col("own") + 0.3 * F.col("hierarchy") + 0.1 * F.col("coherence"), 6))


def candidates(hits: DataFrame, top_docs: int, cfg: RerankConfig = RerankConfig()) -> DataFrame:
    """All hits where a query has at most max_candidates; else those of its best 2 * top_docs documents."""
    total = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    docs = hits.groupBy(*BY).agg(F.max("score").alias("doc_score")).withColumn("doc_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("doc_score"), "doc_key")))
    full = hits.withColumn("total", total).join(docs, BY)
    return full.filter((F.col("total") <= cfg.max_candidates) | (F.col("doc_rank") <= 2 * top_docs)).drop("total", "doc_score", "doc_rank")


def rerank(hits: DataFrame, top_docs: int = 5, chunks_per_doc: int = 4, cfg: RerankConfig = RerankConfig(), pair_score: Column | None = None) -> DataFrame:
    """The best hits of the best documents: (query_id, doc_key, doc_rank, id, rank, final, order_key, ...).

    Hits below the early-stopping score are dropped where their document has one above it. A document's
    order key is its best score and shares of the hierarchy and coherence of the hits that it keeps.
    """
    scored = hit_scores(candidates(hits, top_docs, cfg), cfg, pair_score)
    w = Window.partitionBy(*BY)
    kept = scored.withColumn("peak", F.max("final").over(w)).filter((F.col("final") >= cfg.early_stopping) | (F.col("peak") < cfg.early_stopping))
    # read four times below, and each time planned and scored again without a cut
    top = cut(kept.withColumn("rank", F.row_number().over(w.orderBy(F.desc("final"), "id"))).filter(F.col("rank") <= chunks_per_doc).drop("peak", "hierarchy", "coherence"))
    docs = top.groupBy(*BY).agg(F.max("final").alias("best")).join(hierarchy_score(top), BY).join(coherence(top, cfg), BY, "left")
    keyed = docs.withColumn("order_key", F.round(F.col("best") + cfg.hierarchy_weight * F.col("hierarchy") + cfg.coherence_weight * F.coalesce("coherence", F.lit(0.0)), 6))
    ranked = keyed.withColumn("doc_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("order_key"), "doc_key"))).filter(F.col("doc_rank") <= top_docs)
    return top.join(ranked.select(*BY, "order_key", "doc_rank"), BY)
