"""Scores of documents: fields, BM25, the rare-token gate, fusion, entity bonus, graph merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korpusline.config import FusionWeights, GateConfig, SearchConfig
from korpusline.functions import text as tx
from korpusline.functions import vectors as vc
from korpusline.operators import search as se

# The usual parameters of Okapi BM25.
K1, B, EPSILON = 1.5, 0.75, 0.25


def _idf(df: DataFrame, docs: DataFrame) -> DataFrame:
    """df (token, df) as (token, mean_length, idf): ln(N - df + 0.5) - ln(df + 0.5), a negative one replaced by EPSILON times the mean."""
    size = docs.filter(F.size("nav_tokens") > 0).agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("nav_tokens")).alias("mean_length"))
    raw = df.crossJoin(F.broadcast(size)).withColumn("idf", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("idf").alias("mean_idf"))  # one row
    return raw.crossJoin(F.broadcast(mean)).select("token", "mean_length", F.when(F.col("idf") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("idf")).alias("idf"))


def bm25(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, doc_key, bm25) of the documents that share a token with the query.

    docs: doc_key, nav_tokens. Postings are (token, document, count), joined on the token.
    """
    postings = docs.select("doc_key", F.size("nav_tokens").alias("length"), F.explode("nav_tokens").alias("token")).groupBy("token", "doc_key", "length").agg(F.count(F.lit(1)).alias("tf"))
    idf = _idf(postings.groupBy("token").agg(F.count(F.lit(1)).alias("df")), docs)
    terms = queries.select("query_id", F.explode(tx.tokens("query")).alias("token")).join(idf, "token")
    met = terms.join(postings, "token")
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    return met.groupBy("query_id", "doc_key").agg(F.round(F.sum(part), 6).alias("bm25"))


def _lengths(docs: DataFrame) -> DataFrame:
    """(doc_key, length, tokens): rows of one document that are of equal length count as one, as in bm25's postings."""
    return docs.groupBy("doc_key", F.size("nav_tokens").alias("length")).agg(F.flatten(F.collect_list("nav_tokens")).alias("tokens"))


def _bodies(docs: DataFrame) -> DataFrame:
    return _lengths(docs).groupBy("doc_key").agg(F.collect_list(F.struct("length", "tokens")).alias("bodies"))


def _terms(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, terms): the query's tokens that any document has, each as often as in the query."""
    df = _lengths(docs).select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    asked = queries.select("query_id", F.explode(tx.tokens("query")).alias("token")).join(_idf(df, docs), "token")
    return asked.groupBy("query_id").agg(F.collect_list(F.struct("token", "idf", "mean_length")).alias("terms"))


def minmax_by_query(rows: DataFrame, value: str, out: str) -> DataFrame:
    """The value scaled to 0..1 among the rows of its query."""
    ends = rows.groupBy("query_id").agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    return rows.join(ends, "query_id").withColumn(out, vc.minmax(F.col(value), F.col("_low"), F.col("_high"))).drop("_low", "_high")


def _product(field: str) -> Column:
    return F.coalesce(F.round(vc.dot("query_vec", f"{field}_vec"), 9), F.lit(0.0)).alias(f"{field}_score")


def field_scores(queries: DataFrame, docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (query_id, doc_key) with the query's products with heading, path and category vectors; 0 for an unknown document."""
    vectors = docs.select("doc_key", "heading_vec", "path_vec", "category_vec")
    full = pairs.join(se.encoded(queries).select("query_id", "query_vec"), "query_id").join(vectors, "doc_key", "left")
    return full.select("query_id", "doc_key", _product("heading"), _product("path"), _product("category"))


def _rare(queries: DataFrame, docs: DataFrame, lexicon: DataFrame, cfg: GateConfig) -> DataFrame:
    """(query_id, rare): the query's rare tokens, no row without any."""
    total = docs.agg(F.count(F.lit(1)).alias("n"))  # one row
    asked = queries.select("query_id", F.explode(F.array_distinct(tx.tokens("query"))).alias("token")).join(lexicon, "token").crossJoin(F.broadcast(total))
    return asked.filter(F.col("df") <= (1 - cfg.quantile) * F.col("n")).groupBy("query_id").agg(F.collect_set("token").alias("rare"))


def _gate(cfg: GateConfig) -> Column:
    """Of nav_tokens (null: no fields, so null) and rare."""
    share = F.size(F.array_intersect("rare", "nav_tokens")) / F.size("rare")
    return F.when(F.col("nav_tokens").isNull(), None).when(F.size("nav_tokens") == 0, cfg.no_tokens).when(F.col("rare").isNull(), 1.0).otherwise(1 - (1 - share) * cfg.penalty)


def idf_gate(queries: DataFrame, docs: DataFrame, lexicon: DataFrame, pairs: DataFrame, cfg: GateConfig = GateConfig()) -> DataFrame:
    """(query_id, doc_key, gate) of the pairs (query_id, doc_key), by the query's rare tokens.

    Rare: 0 < df <= (1 - quantile) * N, N all docs. gate = 1 - (1 - share of rare tokens in the document) * penalty;
    documents without tokens get cfg.no_tokens, queries without rare tokens give 1. Unknown documents have no row.
    """
    full = pairs.select("query_id", "doc_key").distinct().join(docs.select("doc_key", "nav_tokens"), "doc_key").join(_rare(queries, docs, lexicon, cfg), "query_id", "left")
    return full.select("query_id", "doc_key", F.round(_gate(cfg), 9).alias("gate"))


def fused(w: FusionWeights) -> Column:
    """(dense + weighted fields + bm25) * gate."""
    return (w.dense * F.col("dense") + w.heading * F.col("heading_score") + w.path * F.col("path_score") + w.category * F.col("category_score") + w.bm25 * F.col("bm25_scaled")) * F.col("gate")


def entity_bonus(domain: Column, attributes: Column) -> Column:
    """0.3 where the domain's name is in the category, 0.2 where any attribute is in the heading text; 1 at most."""
    in_category = F.coalesce(F.contains(F.lower("category"), F.lower(domain)), F.lit(False))
    in_heading = F.coalesce(F.exists(attributes, lambda a: F.contains(F.lower("heading_text"), F.lower(a))), F.lit(False))
    return F.least(F.lit(1.0), F.when(in_category, 0.3).otherwise(0.0) + F.when(in_heading, 0.2).otherwise(0.0))


def fuse(dense: DataFrame, queries: DataFrame, docs: DataFrame, lexicon: DataFrame, cfg: SearchConfig = SearchConfig(), keep: tuple[str, ...] = ()) -> DataFrame:
    """dense (query_id, doc_key, dense) with all scores, `fused` and the columns of docs to keep.

    Documents without fields have scores of 0 and a gate of 1. BM25, gate and products are found for the pairs of
    dense alone: each meets its query's terms and its document's fields once.
    """
    asked = se.encoded(queries).select("query_id", "query_vec").join(_terms(queries, docs), "query_id", "left").join(_rare(queries, docs, lexicon, cfg.gate), "query_id", "left")
    fields = docs.select("doc_key", "nav_tokens", "heading_vec", "path_vec", "category_vec", *keep).join(_bodies(docs), "doc_key")
    full = dense.join(asked, "query_id").join(fields, "doc_key", "left")

    def part(term: Column, body: Column) -> Column:
        tf = F.size(F.filter(body["tokens"], lambda x: x == term["token"]))
        return F.when(tf > 0, term["idf"] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * body["length"] / term["mean_length"]))).otherwise(0.0)

    bm25_ = F.aggregate("terms", F.lit(0.0), lambda s, t: s + F.aggregate("bodies", F.lit(0.0), lambda u, b: u + part(t, b)))
    scored = full.select(
        "query_id", "doc_key", "dense", F.coalesce(F.round(bm25_, 6), F.lit(0.0)).alias("bm25"), *[_product(f) for f in ("heading", "path", "category")],
        F.coalesce(F.round(_gate(cfg.gate), 9), F.lit(1.0)).alias("gate"), *keep,
    )
    w = Window.partitionBy("query_id")
    scaled = scored.withColumn("bm25_scaled", vc.minmax(F.col("bm25"), F.min("bm25").over(w), F.max("bm25").over(w)))
    return scaled.withColumn("fused", F.round(fused(cfg.weights), 6))


def graph_merge(scored: DataFrame, graph: DataFrame, weight: float = 0.3) -> DataFrame:
    """(query_id, doc_key, score, origin): graph results added to the documents they name, the others as documents of their own.

    scored: query_id, doc_key, score; graph: query_id, node_id, name, graph_score, content. A result
    belongs to the best-scored document whose key contains its name or is contained in it.
    """
    pair = scored.alias("d").join(graph.alias("g"), (F.col("d.query_id") == F.col("g.query_id")) & (F.contains(F.col("d.doc_key"), F.col("g.name")) | F.contains(F.col("g.name"), F.col("d.doc_key"))))
    chosen = pair.groupBy("g.query_id", "g.node_id").agg(F.max_by(F.struct(F.col("d.doc_key").alias("doc_key"), F.col("g.graph_score").alias("graph_score")), F.struct("d.score", "d.doc_key")).alias("x"))
    added = chosen.groupBy("query_id", F.col("x.doc_key").alias("doc_key")).agg(F.max("x.graph_score").alias("graph_score"))
    own = scored.join(added, ["query_id", "doc_key"], "left").select("query_id", "doc_key", F.round(F.col("score") + weight * F.coalesce("graph_score", F.lit(0.0)), 6).alias("score"), F.lit("text").alias("origin"))
    alone = graph.join(chosen.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti").filter(F.coalesce(F.trim("content"), F.lit("")) != "")
    return own.unionByName(alone.select("query_id", F.col("node_id").alias("doc_key"), F.round(weight * F.col("graph_score"), 6).alias("score"), F.lit("graph").alias("origin")))
