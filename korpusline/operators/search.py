"""Vector search over chunks: top-k with post-filters, neighbour windows, grouping by document.

Queries are a DataFrame (query_id, query) and every stage keeps query_id, so one or many run in the
same plan. Vectors meet as block products in Arrow batches; the query set is broadcast only up to
BROADCAST_QUERIES rows and met block by block beyond. Per query only the best rows survive the first stage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korpusline.functions import text as tx
from korpusline.functions import vectors as vc
from korpusline.schema import CHUNKS

#: Rows of queries up to which they are broadcast (64 doubles each, so a few MB at most), and rows of a block beyond it.
BROADCAST_QUERIES = 5000
BLOCK_ROWS = 4096


def index(chunks: DataFrame) -> DataFrame:
    """Chunks with doc_key and unit vector `vec`, each id once; the text is kept for contexts, columns that chunks don't have are not."""
    known = [c.split()[0] for c in CHUNKS.split(", ")]
    return chunks.withColumn("doc_key", tx.doc_key()).select([c for c in chunks.columns if c in known and c != "doc_key"] + ["doc_key"]).dropDuplicates(["id"]).withColumn("vec", vc.encode("text"))


def encoded(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", "query", vc.encode("query").alias("query_vec"))


def best(rows: DataFrame, k: int | Column, *order: Column, by: str = "query_id", rank: str = "rank") -> DataFrame:
    """The first k rows of each query; the limit is applied before the shuffle too."""
    ranked = rows.withColumn(rank, F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return ranked.filter(F.col(rank) <= k)


def _best_of(scores: np.ndarray, asked: list, ids: pa.Array, k: int) -> pa.RecordBatch:
    """(query_id, id, score) of the rows that may be among a query's k best: those at least as good as its k-th."""
    least = np.partition(scores, max(0, len(scores) - k), axis=0)[max(0, len(scores) - k)]
    row, query = np.nonzero(scores >= least[None, :])
    return pa.RecordBatch.from_arrays([asked.take(pa.array(query)), ids.take(pa.array(row)), pa.array(scores[row, query])], ["query_id", "id", "score"])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def top_k(queries: DataFrame, indexed: DataFrame, k: int, id_column: str = "id", vec: str = "vec") -> DataFrame:
    """(query_id, rank, score, id): the exact k nearest by inner product; ties by id.

    Products are made a block at a time, and only rows as good as the k-th of their block go on. The
    queries are broadcast up to BROADCAST_QUERIES rows; beyond it both sides are cut into blocks, and each
    pair of blocks is one group. Scores are rounded to 9 places so that equal ones tie.
    """
    spark, kinds = indexed.sparkSession, {f.name: f.dataType.simpleString() for f in (*queries.schema, *indexed.schema)}
    asked, stored = queries.select("query_id", "query_vec"), indexed.select(F.col(id_column).alias("id"), F.col(vec).alias("vec")).filter("vec is not null")
    out = f"query_id {kinds['query_id']}, id {kinds[id_column]}, score double"
    few = asked.limit(BROADCAST_QUERIES + 1).toArrow()
    if few.num_rows <= BROADCAST_QUERIES:
        few = few.combine_chunks()
        sent = spark.sparkContext.broadcast((few.column(0).combine_chunks(), _matrix(few.column(1).combine_chunks()) if few.num_rows else None))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, vectors = sent.value
            for batch in batches if vectors is not None else ():
                if batch.num_rows:
                    yield _best_of(np.round(_matrix(batch.column(1)) @ vectors.T, 9), ids, batch.column(0), k)

        scored = stored.mapInArrow(run, out)
    else:
        blocks = {side: rows.count() // BLOCK_ROWS + 1 for side, rows in (("q", asked), ("s", stored))}

        def blocked(rows: DataFrame, key: str, side: str, other: str) -> DataFrame:
            own = F.pmod(F.xxhash64(key), F.lit(blocks[side]).cast("bigint")).alias(side)
            return rows.select(own, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks[other] - 1).cast("bigint"))).alias(other), *rows.columns)

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            a, b = left.combine_chunks(), right.combine_chunks()
            if not a.num_rows or not b.num_rows:
                return pa.table({"query_id": a.column("query_id").slice(0, 0), "id": b.column("id").slice(0, 0), "score": pa.array([], pa.float64())})
            scores = np.round(_matrix(b.column("vec").combine_chunks()) @ _matrix(a.column("query_vec").combine_chunks()).T, 9)
            return pa.Table.from_batches([_best_of(scores, a.column("query_id").combine_chunks(), b.column("id").combine_chunks(), k)])

        scored = blocked(asked, "query_id", "q", "s").groupBy("q", "s").cogroup(blocked(stored, "id", "s", "q").groupBy("q", "s")).applyInArrow(meet, out)
    return best(scored.withColumnRenamed("id", id_column), k, F.desc("score"), F.col(id_column))


def _starts(prefix: str) -> Column:
    return F.exists("heading_path", lambda h: F.startswith(h, F.lit(prefix)))


def filters(categories=None, doc_ids=None, doc_paths=None, heading_prefixes=None, min_score=None, joined: bool = False, unknown: str | None = None) -> Column:
    """Post-filters; an empty list filters nothing, null fields never match.

    joined: heading prefixes are compared with the whole path joined by ` > `, white space squeezed;
    else any heading may start with any prefix. unknown: what a null category counts as.
    """
    out = F.lit(True)
    category = F.coalesce(tx.filled("category"), F.lit(unknown)) if unknown else F.col("category")
    for column, values in ((category, categories), (F.col("doc_id"), doc_ids), (F.col("doc_path"), doc_paths)):
        if values:
            out = out & F.coalesce(column.isin(*values), F.lit(False))
    if heading_prefixes:
        whole = tx.squeeze(F.array_join("heading_path", " > "))
        some = [whole.startswith(" ".join(p.split())) if joined else _starts(p) for p in heading_prefixes]
        match = some[0]
        for x in some[1:]:
            match = match | x
        out = out & F.coalesce(match, F.lit(False))
    if min_score is not None:
        out = out & (F.col("score") >= min_score)
    return out


def hits_by_document(hits: DataFrame) -> DataFrame:
    """One row per query and document: best score, hits by score, their texts, page span, heading preview."""
    hit = F.struct((-F.col("score")).alias("minus"), "id", "chunk_index", "text", "heading_path", "page_from", "page_to")
    grouped = hits.groupBy("query_id", "doc_key").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("hits"), F.array_sort(F.collect_list(hit)).alias("all"), F.min(F.least("page_from", "page_to")).alias("page_first"), F.max(F.greatest("page_from", "page_to")).alias("page_last"))
    texts = F.filter(F.transform("all", lambda x: F.trim(x["text"])), lambda t: t != "")
    return grouped.select("query_id", "doc_key", "score", "hits", F.array_join(texts, "\n\n").alias("context"), "page_first", "page_last", tx.heading_preview(F.get("all", F.lit(0))["heading_path"]).alias("heading_preview"), F.transform("all", lambda x: x["id"]).alias("chunk_ids"))


def search_raw(queries: DataFrame, indexed: DataFrame, top: int = 10, oversample: int = 5, **conditions) -> DataFrame:
    """The surviving hits of an oversampled search: top * oversample nearest, then filters, then the first `top`.

    Without a filter all survive, so the first `top` are looked for at once.
    """
    narrowed = any(v if k != "min_score" else v is not None for k, v in conditions.items())
    near = top_k(encoded(queries), indexed, top * (oversample if narrowed else 1))
    full = near.join(indexed.drop("vec"), "id").filter(filters(**conditions))
    return best(full.withColumnRenamed("rank", "rank_before"), top, F.col("rank_before"))


def hysteresis(hits: DataFrame, top: int) -> DataFrame:
    """Hits up to the first at which at least `top` documents and 3 * top hits are gathered; that hit is kept."""
    w = Window.partitionBy("query_id").orderBy("rank")
    first = hits.withColumn("new_doc", F.when(F.row_number().over(Window.partitionBy("query_id", "doc_key").orderBy("rank")) == 1, 1).otherwise(0))
    counted = first.withColumn("docs", F.sum("new_doc").over(w)).withColumn("n", F.row_number().over(w))
    full = (F.col("docs") >= top) & (F.col("n") >= 3 * top)
    before = F.coalesce(F.max(F.when(full, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counted.withColumn("stopped", before).filter("stopped = 0").drop("new_doc", "docs", "n", "stopped")


def positions(indexed: DataFrame) -> DataFrame:
    """(id, doc_key, pos): the place of each chunk in its document, by order range and chunk_index."""
    from korpusline.functions.scan import running_count

    placed = indexed.select("id", "doc_key", (F.coalesce("from_order", F.lit(0)).cast("bigint") * 100_000 + F.coalesce("to_order", F.lit(0))).alias("place"), F.concat(F.lpad(F.coalesce("chunk_index", F.lit(0)).cast("string"), 9, "0"), "id").alias("tie"))
    return running_count(placed, ["doc_key"], "place", "tie", "pos", block=4096 * 100_000).select("id", "doc_key", "pos")


def window_context(hits: DataFrame, indexed: DataFrame, window: int) -> DataFrame:
    """(query_id, doc_key, pos, id): the hits and their neighbours up to `window` places away, each once.

    A range join as an equi-join: each hit asks for the positions around it.
    """
    placed = positions(indexed)
    around = hits.select("query_id", "id").join(placed, "id").select("query_id", "doc_key", F.explode(F.sequence(F.col("pos") - window, F.col("pos") + window)).alias("pos")).distinct()
    return around.join(placed, ["doc_key", "pos"]).select("query_id", "doc_key", "pos", "id")


def search_window(queries: DataFrame, indexed: DataFrame, top: int = 10, oversample: int = 5, window: int = 1, **conditions) -> DataFrame:
    """Documents with the texts around their hits: (query_id, doc_key, score, context, page_first, page_last, heading_preview, rank)."""
    near = top_k(encoded(queries), indexed, top * oversample)
    kept = hysteresis(near.join(indexed.drop("vec"), "id").filter(filters(joined=True, unknown="UNK", **conditions)), top)
    docs = kept.groupBy("query_id", "doc_key").agg(F.max("score").alias("score"), F.min_by("heading_path", "rank").alias("first_path"))
    around = window_context(kept, indexed, window).join(indexed.select("id", "text", "page_from", "page_to"), "id")
    context = around.groupBy("query_id", "doc_key").agg(
        F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("all"), F.min(F.least("page_from", "page_to")).alias("page_first"), F.max(F.greatest("page_from", "page_to")).alias("page_last")
    )
    full = docs.join(context, ["query_id", "doc_key"]).select("query_id", "doc_key", "score", F.array_join(F.filter(F.transform("all", lambda x: F.trim(x["text"])), lambda t: t != ""), "\n\n").alias("context"), "page_first", "page_last", tx.heading_preview("first_path").alias("heading_preview"))
    return best(full, top, F.desc("score"), F.col("doc_key"))
