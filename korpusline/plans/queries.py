"""The registered queries of the engine's own operators. Each reads its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korpusline.config import ContextConfig, GraphConfig, RerankConfig, SearchConfig
from korpusline.functions import text as tx
from korpusline.functions import vectors as vc
from korpusline.functions.session import cut, table, written
from korpusline.operators import chunking, context, entities, fields, graph, graph_search, ranking, rerank, search
from korpusline.sources import charset, files, markup, tables
from korpusline.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(f: Query) -> Query:
    REGISTRY[f.__name__] = f
    return f


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _index(spark: SparkSession, d: str) -> DataFrame:
    # read several times by a search, with its vectors: written once
    return written(search.index(table(spark, d, "chunks").drop("indexed_at").filter("text is not null")), "index")


def _stations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dictionaries").filter("dict_name = 'stations'")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "doc_fields_meta").withColumn("nav_tokens", fields.nav_tokens())


def _hits(spark: SparkSession, d: str) -> DataFrame:
    """Chunks as the hits of one query per category, with a score of their own: work for the operators after search."""
    rows = table(spark, d, "chunks").drop("indexed_at").filter("category is not null and text is not null").dropDuplicates(["id"])
    return rows.select(F.col("category").alias("query_id"), F.element_at(F.split("category", "/"), -1).alias("query"), tx.doc_key().alias("doc_key"), "id", "category", "doc_path", "chunk_index", "text", "heading_path", "page_from", "page_to", (F.pmod(F.conv(F.substring(F.md5("id"), 1, 6), 16, 10).cast("bigint"), F.lit(1000003)) / 1000003).alias("score"))


# sources


@query
def src_lines(spark, d):
    return files.lines(table(spark, d, "documents"), "doc_id").withColumnRenamed("key", "doc_id")


@query
def src_db_rows(spark, d):
    return tables.row_elements(table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type"), "parts")


@query
def src_db_title(spark, d):
    return tables.row_elements(table(spark, d, "part").select("p_partkey", "p_name", "p_type"), "parts")


@query
def src_named_rows(spark, d):
    return table(spark, d, "orders").select("o_orderkey", tx.row_text({"order": "o_orderkey", "status": "o_orderstatus", "priority": "o_orderpriority"}).alias("text"))


@query
def src_html_elements(spark, d):
    pages = table(spark, d, "elements").filter("html is not null").select(F.col("id").alias("key"), "html").dropDuplicates(["key"])
    return markup.parsed(pages).withColumnRenamed("key", "id")


@query
def src_union_formats(spark, d):
    lines = files.lines(table(spark, d, "documents"), "doc_id").groupBy().agg(F.count(F.lit(1)).alias("n")).select(F.lit("lines").alias("source"), "n")
    rows = tables.row_elements(table(spark, d, "part").select("p_partkey", "p_name", "p_type")).groupBy("element_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("element_type").alias("source"), "n")
    return lines.unionByName(rows)


@query
def src_charset(spark, d):
    """Texts of Russian letters as bytes of cp1251, the others as UTF-8, every other one with a byte order mark."""
    rows = table(spark, d, "documents").filter("length(text) > 0")
    # the letters stand in cp1251 where Latin-1 has others: encoding these gives the bytes
    letters = "".join(map(chr, range(0x410, 0x450))) + "Ёё"
    shown = "".join(map(chr, range(0xC0, 0x100))) + "¨¸"
    russian = F.encode(F.translate("text", letters, shown), "ISO-8859-1")
    marked = F.concat(F.unhex(F.when(F.col("doc_id") % 2 == 0, "EFBBBF").otherwise("")), F.encode("text", "UTF-8"))
    content = F.when(F.col("text").rlike(r"^[\x00-\x7fА-яЁё]*$") & F.col("text").rlike("[А-яЁё]"), russian).otherwise(marked)
    return rows.select("doc_id", charset.decoded()(content).alias("x")).select("doc_id", F.md5("x.text").alias("text_md5"), F.col("x.encoding").alias("encoding"))


@query
def src_block_order(spark, d):
    blocks = fields.keyed(table(spark, d, "elements").filter("bbox is not null").select("id", "category", "doc_id", "doc_path", "page", "bbox"))
    return files.block_order(blocks.select("doc_key", "page", "id", "bbox"))


@query
def file_counts(spark, d):
    return files.file_counts(table(spark, d, "doc_fields_meta").select(F.col("doc_path").alias("path")))


@query
def path_parts(spark, d):
    p = "doc_path"
    return table(spark, d, "doc_fields_meta").select("row_no", files.extension(p).alias("ext"), files.stem(p).alias("stem"), files.folder_of(p).alias("folder"), files.is_read(p).alias("is_read"))


# text functions


@query
def path_text(spark, d):
    return table(spark, d, "doc_fields_meta").select("row_no", tx.path_text("doc_path").alias("path_words"))


@query
def tokens_norm(spark, d):
    return table(spark, d, "documents").select(F.explode(tx.tokens("text")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query
def words_unicode(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(tx.words("text")).alias("words"), F.size(F.array_distinct(tx.words("text"))).alias("different"))


@query
def token_len(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", tx.token_count("text").alias("tokens"))


@query
def normalised_text(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.md5(tx.normalise("text")).alias("text_md5"))


@query
def headings_flag(spark, d):
    rows = table(spark, d, "elements").filter("text is not null").dropDuplicates(["id"])
    return rows.select("id", tx.is_heading("text").alias("heads"), tx.heading_depth("text").alias("depth"), tx.section_number("text").alias("section"))


@query
def section_ids(spark, d):
    rows = table(spark, d, "chunks").dropDuplicates(["id"])
    return rows.select("id", tx.section_id("heading_path").alias("section"), tx.hierarchy_level("heading_path").alias("level"), tx.heading_preview("heading_path").alias("preview"))


@query
def references(spark, d):
    rows = table(spark, d, "elements").filter("text is not null").dropDuplicates(["id"])
    return rows.select("id", F.posexplode(tx.references("text")).alias("n", "target"))


@query
def sentences(spark, d):
    return chunking.sentence_rows(table(spark, d, "documents"), "doc_id").withColumnRenamed("buffer", "doc_id")


@query
def text_cuts(spark, d):
    rows = table(spark, d, "documents").filter("text is not null")
    return rows.select("doc_id", F.md5(tx.cut_tokens("text")).alias("cut_md5"), F.md5(F.substring("text", 1, 500)).alias("preview_md5"))


@query
def smart_truncate(spark, d):
    rows = table(spark, d, "documents").filter("length(text) > 0")
    return rows.select("doc_id", tx.smart_truncate("text", 100).alias("short"))


@query
def doc_keys(spark, d):
    rows = table(spark, d, "doc_fields_meta")
    return rows.select("row_no", tx.doc_key().alias("doc_key"), tx.split_doc_key(tx.doc_key())["document"].alias("document"))


@query
def citations(spark, d):
    return table(spark, d, "chunks").dropDuplicates(["id"]).select("id", tx.citation("category", "doc_path", "page_from", "page_to").alias("citation"))


@query
def word_hit_ratio(spark, d):
    rows = table(spark, d, "chunks").filter("text is not null").dropDuplicates(["id"])
    return rows.select("id", F.round(tx.word_hit_ratio(tx.heading_preview("heading_path"), "text"), 6).alias("ratio"))


# documents and fields


@query
def elements_grouped(spark, d):
    return fields.documents_of(table(spark, d, "elements"))


@query
def heading_texts(spark, d):
    return fields.heading_texts(table(spark, d, "elements"))


@query
def doc_fields(spark, d):
    return fields.doc_fields(table(spark, d, "elements")).select("doc_key", "heading_text", "path_text", F.size("nav_tokens").alias("tokens"))


@query
def lexicon_df(spark, d):
    return fields.lexicon(table(spark, d, "doc_fields_meta"))


# chunking


@query
def heading_paths(spark, d):
    rows = chunking.heading_paths(table(spark, d, "elements"))
    return rows.select("id", "heads", F.array_join("path", " > ").alias("path"))


@query
def adjacent_cuts(spark, d):
    rows = chunking.adjacent_cuts(chunking.sentence_rows(table(spark, d, "documents"), "doc_id"))
    return rows.select(F.col("buffer").alias("doc_id"), "pos", F.round("similarity", 6).alias("similarity"))


@query
def segments(spark, d):
    rows = chunking.segments(chunking.sentence_rows(table(spark, d, "documents"), "doc_id"), 120)
    return rows.withColumnRenamed("buffer", "doc_id")


@query
def chunks(spark, d):
    return chunking.build_chunks(table(spark, d, "elements"))


# vectors and search


@query
def hash_encode(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(vc.encode("text")).alias("place", "value"))
    return rows.filter("value <> 0").select("doc_id", "place", F.round("value", 6).alias("value"))


@query
def knn_topk(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    asked = rows.filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vec"))
    return search.top_k(asked, rows, 10, vec="embedding").withColumn("score", F.round("score", 6))


@query
def knn_filtered(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    asked = rows.filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vec"))
    near = search.top_k(asked, rows, 50, vec="embedding").join(rows.select("id", "label"), "id").filter(F.col("label").isin(1, 3, 5) & (F.col("score") >= 0.05))
    return search.best(near.withColumnRenamed("rank", "rank_before"), 10, F.col("rank_before")).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@query
def search_raw(spark, d):
    found = search.search_raw(_questions(spark, d), _index(spark, d), 10, 5)
    return found.select("query_id", "rank", "id", "doc_key", F.round("score", 6).alias("score"))


@query
def search_documents(spark, d):
    found = search.search_raw(_questions(spark, d), _index(spark, d), 10, 5)
    return search.hits_by_document(found).select("query_id", "doc_key", F.round("score", 6).alias("score"), "hits", "page_first", "page_last")


@query
def search_window(spark, d):
    found = search.search_window(_questions(spark, d), _index(spark, d), 5, 5, 1)
    return found.select("query_id", "rank", "doc_key", F.round("score", 6).alias("score"), "page_first", "page_last", F.length("context").alias("context_chars"))


@query
def heading_prefix(spark, d):
    rows = table(spark, d, "chunks").dropDuplicates(["id"])
    a = rows.filter(search.filters(heading_prefixes=["1.", "Раздел"])).select("id", F.lit("any").alias("kind"))
    b = rows.filter(search.filters(heading_prefixes=["Логистика >  Акты", "ПТО"], joined=True)).select("id", F.lit("joined").alias("kind"))
    return a.unionByName(b)


@query
def category_filter(spark, d):
    rows = table(spark, d, "chunks").dropDuplicates(["id"])
    return rows.filter(search.filters(categories=["UNK", "ПТО/Переписка"], unknown="UNK")).select("id", "category")


@query
def chunk_positions(spark, d):
    return search.positions(_index(spark, d))


# ranking


@query
def bm25(spark, d):
    return ranking.bm25(_questions(spark, d), _docs(spark, d))


@query
def bm25_minmax(spark, d):
    scaled = ranking.minmax_by_query(ranking.bm25(_questions(spark, d), _docs(spark, d)), "bm25", "scaled")
    return scaled.select("query_id", "doc_key", F.round("scaled", 4).alias("scaled"))


@query
def idf_gate(spark, d):
    """The gate of the pairs that share a token."""
    docs, asked = _docs(spark, d), _questions(spark, d)
    return ranking.idf_gate(asked, docs, fields.lexicon(docs), ranking.bm25(asked, docs)).select("query_id", "doc_key", F.round("gate", 6).alias("gate"))


def _found(spark, d):
    """(the index, the hits of the questions' searches: query_id, id, doc_key, score)."""
    cfg, indexed = SearchConfig(), _index(spark, d)
    return indexed, cut(search.search_raw(_questions(spark, d), indexed, cfg.semantic_top_k, cfg.oversample).select("query_id", "id", "doc_key", "score"))


def _dense(found):
    return found.groupBy("query_id", "doc_key").agg(F.max("score").alias("dense"))


def _field_docs(spark, d):
    own = _docs(spark, d)
    return own.withColumns({"heading_vec": vc.encode("heading_text"), "path_vec": vc.encode("path_text"), "category_vec": vc.encode("category")})


@query
def fusion(spark, d):
    docs = _field_docs(spark, d)
    return ranking.fuse(_dense(_found(spark, d)[1]), _questions(spark, d), docs, fields.lexicon(docs)).select("query_id", "doc_key", "heading_score", "path_score", "category_score", "bm25", "gate", "fused")


def _universal(spark, d, found):
    """(query_id, doc_key, score, origin): the hits' documents, fused, with entity bonus and graph results."""
    docs, asked = _field_docs(spark, d), _questions(spark, d)
    fused = ranking.fuse(_dense(found), asked, docs, fields.lexicon(docs), keep=("category", "heading_text"))
    named = entities.extract(asked, _stations(spark, d)).select("query_id", "domain", "object_attributes")
    bonus = fused.join(named, "query_id").withColumn("score", F.round(F.col("fused") + SearchConfig().weights.entity * ranking.entity_bonus(F.col("domain"), F.col("object_attributes")), 6))
    bonus = cut(bonus.select("query_id", "doc_key", "score"))
    node, near = _graph_hits(spark, d)
    near = cut(near.join(node.select("id", F.coalesce("doc_key", "id").alias("name")), "id").select("query_id", F.col("id").alias("node_id"), "name", "graph_score", F.col("preview").alias("content")))
    return ranking.graph_merge(bonus, near)


@query
def universal_search(spark, d):
    """The best five documents per query."""
    return search.best(_universal(spark, d, _found(spark, d)[1]), SearchConfig().top_k_docs, F.desc("score"), F.col("doc_key"))


def _pipeline_hits(spark, d):
    """The hits of the questions' searches in the documents that universal search puts first."""
    indexed, found = _found(spark, d)
    best = cut(search.best(_universal(spark, d, found), 2 * SearchConfig().top_k_docs, F.desc("score"), F.col("doc_key"))).filter("origin = 'text'")
    hits = found.join(best.select("query_id", "doc_key"), ["query_id", "doc_key"])
    return cut(hits.join(indexed.drop("vec", "doc_key"), "id").join(_questions(spark, d), "query_id"))


@query
def pipeline_context(spark, d):
    """Universal search, reranking and packing of a context, one after the other, for all questions."""
    best = cut(rerank.rerank(_pipeline_hits(spark, d), SearchConfig().top_k_docs, SearchConfig().max_chunks_per_doc))
    packed = cut(context.pack(context.items(best), ContextConfig()))
    return context.prompt(packed).join(packed.groupBy("query_id").agg(F.count(F.lit(1)).alias("items"), F.sum("tokens").alias("tokens")), "query_id")


@query
def hierarchy_scores(spark, d):
    return rerank.hierarchy_score(_hits(spark, d)).select("query_id", "doc_key", F.round("hierarchy", 6).alias("hierarchy"))


@query
def page_coherence(spark, d):
    return rerank.coherence(_hits(spark, d)).select("query_id", "doc_key", F.round("coherence", 6).alias("coherence"))


@query
def rerank_hybrid(spark, d):
    found = rerank.rerank(_hits(spark, d), 5, 4)
    return found.select("query_id", "doc_rank", "doc_key", "rank", "id", "final", "order_key")


@query
def rerank_cosine(spark, d):
    found = rerank.hit_scores(_hits(spark, d), RerankConfig(kind="cosine"))
    return found.select("query_id", "doc_key", "id", F.round("cosine", 6).alias("cosine"), "final")


def _packed(spark, d):
    best = rerank.rerank(_hits(spark, d), 5, 4)
    placed = context.items(best)
    return context.pack(placed, ContextConfig()), placed


@query
def context_pack(spark, d):
    packed, _ = _packed(spark, d)
    return packed


@query
def context_prompt(spark, d):
    return context.prompt(_packed(spark, d)[0])


@query
def context_citations(spark, d):
    return context.citations(*_packed(spark, d))


def _items(spark, d):
    return context.items(_hits(spark, d))


@query
def context_coverage(spark, d):
    return context.coverage(_items(spark, d))


@query
def context_quality(spark, d):
    return context.quality(_items(spark, d))


@query
def context_summary(spark, d):
    return context.summary(_items(spark, d))


# entities


def _texts(spark, d):
    return table(spark, d, "documents").filter("text is not null").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))


@query
def ent_domain(spark, d):
    return _texts(spark, d).select(F.col("query_id").alias("doc_id"), entities.domain("query").alias("domain"))


@query
def ent_standards(spark, d):
    return _texts(spark, d).select(F.col("query_id").alias("doc_id"), F.explode(entities.standards("query")).alias("value"))


@query
def ent_dates(spark, d):
    return _texts(spark, d).select(F.col("query_id").alias("doc_id"), F.explode(entities.dates("query")).alias("value"))


@query
def ent_quantity(spark, d):
    rows = _texts(spark, d).select(F.col("query_id").alias("doc_id"), entities.quantity("query").alias("q")).filter("q is not null")
    return rows.select("doc_id", F.col("q.value").alias("value"), F.col("q.unit").alias("unit"))


@query
def ent_incoterms(spark, d):
    return _texts(spark, d).select(F.col("query_id").alias("doc_id"), F.explode(entities.incoterms("query")).alias("term"))


@query
def ent_identifiers(spark, d):
    return _texts(spark, d).select(F.col("query_id").alias("doc_id"), F.explode(entities.identifiers("query")).alias("value"))


@query
def ent_organisations(spark, d):
    return _texts(spark, d).select(F.col("query_id").alias("doc_id"), F.explode(entities.organisations("query")).alias("value"))


@query
def ent_stations(spark, d):
    return entities.stations(_texts(spark, d), _stations(spark, d)).select(F.col("query_id").alias("doc_id"), "station", "place")


@query
def ent_locations(spark, d):
    return entities.locations(_texts(spark, d), _stations(spark, d)).select(F.col("query_id").alias("doc_id"), "location.origin", "location.destination")


@query
def ent_confidence(spark, d):
    rows = entities.extract(_texts(spark, d), _stations(spark, d)).select(F.col("query_id").alias("doc_id"), F.explode("confidences").alias("field", "confidence"))
    return rows


@query
def ent_merged(spark, d):
    """Rule-based entities of chunks with those of their heading paths merged in, as a model's would be."""
    rows = table(spark, d, "chunks").filter("text is not null").dropDuplicates(["id"])
    rules = entities.extract(rows.select(F.col("id").alias("query_id"), F.col("text").alias("query")))
    model = entities.extract(rows.select(F.col("id").alias("query_id"), F.array_join("heading_path", "\n").alias("query")))
    merged = entities.merge_model(rules, model.select("query_id", "domain", "object_attributes", "identifiers", "actors"))
    return merged.select(F.col("query_id").alias("id"), "domain", F.size("object_attributes").alias("attributes"), F.size("identifiers").alias("identifiers"), F.size("actors").alias("actors"))


@query
def entities_all(spark, d):
    return entities.present(entities.extract(_texts(spark, d), _stations(spark, d))).withColumnRenamed("query_id", "doc_id")


# graph


def _prepared(spark, d):
    return written(graph.prepared(table(spark, d, "elements")), "elements")


def _graph_tables(spark, d):
    rows = _prepared(spark, d)
    return graph.nodes(rows), graph.edges(rows)


@query
def section_importance(spark, d):
    return graph.section_importance(table(spark, d, "elements"))


@query
def section_top(spark, d):
    return graph.top_sections(graph.section_importance(table(spark, d, "elements")))


@query
def graph_folders(spark, d):
    return graph.folder_nodes(table(spark, d, "elements")).select("id", "name", "level", "importance")


@query
def graph_documents(spark, d):
    return graph.document_nodes(table(spark, d, "elements")).select("id", "category", "element_count", "date")


@query
def graph_nodes(spark, d):
    return _graph_tables(spark, d)[0].select("id", "type", "level", "importance", "element_count", "text_length", "has_media")


@query
def graph_edges(spark, d):
    return _graph_tables(spark, d)[1]


def _numbered_chunks(spark, d):
    """The chunks as numbered sections of their documents: texts that refer to sections that are there."""
    rows = table(spark, d, "chunks").filter("text is not null")
    number = F.coalesce(F.col("chunk_index") + 1, F.lit(0)).cast("string")
    return rows.select(
        "id", "category", "doc_id", "doc_path", F.col("page_from").alias("page"), F.col("chunk_index").alias("elem_order"), F.lit("paragraph").alias("element_type"),
        F.concat(number, F.lit(". "), "text").alias("text"), F.lit(None).cast("string").alias("media_path"), F.array(number).alias("headings_path"),
    )


@query
def graph_references(spark, d):
    """References between the numbered chunks of a document."""
    return graph.reference_edges(written(graph.prepared(_numbered_chunks(spark, d)), "chunks"))


@query
def graph_document_analysis(spark, d):
    rows = _prepared(spark, d)
    return graph.document_analysis(graph.section_nodes(rows), graph.reference_edges(rows))


@query
def graph_paths(spark, d):
    """Shortest paths from the folder that is first by name to the element that is last in it."""
    node, edge = map(cut, _graph_tables(spark, d))
    first = node.filter("type = 'folder' and level = 0").agg(F.min("id")).first()[0]
    below = graph.hierarchy(edge, node.filter(F.col("id") == first).select("id")).agg(F.max_by("id", F.struct("depth", "id"))).first()[0]
    return graph.shortest_path(edge, first, below)


@query
def graph_analysis(spark, d):
    return graph.analysis(*_graph_tables(spark, d))


@query
def graph_khop(spark, d):
    node, edge = _graph_tables(spark, d)
    return graph.neighbourhood(node.select("id"), edge, GraphConfig().max_distance)


@query
def graph_tree(spark, d):
    node, edge = map(cut, _graph_tables(spark, d))
    return graph.hierarchy(edge, node.filter("type = 'document'").select("id"))


@query
def graph_pagerank(spark, d):
    node, edge = map(cut, _graph_tables(spark, d))
    return graph.pagerank(node, edge)


@query
def graph_importance(spark, d):
    node, edge = map(cut, _graph_tables(spark, d))
    return graph.node_importance(node, graph.pagerank(node, edge))


@query
def relevant_sections(spark, d):
    return graph.relevant_sections(_questions(spark, d), graph.section_nodes(table(spark, d, "elements")))


def _contents(spark, d):
    rows = fields.keyed(table(spark, d, "chunks").filter("text is not null").select("id", "category", "doc_id", "doc_path", "chunk_index", "text"))
    first = rows.groupBy("doc_key").agg(F.min_by("text", F.struct("chunk_index", "id")).alias("content"))
    return first.select(F.concat(F.lit("document::"), "doc_key").alias("id"), "content")


def _entity_index(spark, d):
    node = graph.document_nodes(table(spark, d, "elements")).select("id")
    return graph.entity_index(node, _contents(spark, d).withColumnRenamed("content", "text"))


@query
def entity_index(spark, d):
    return _entity_index(spark, d)


def _graph_hits(spark, d):
    """(nodes, hits of the questions in the whole graph)."""
    # each is used several times below; written once instead of planned and computed again
    node, edge = (written(x, name) for x, name in zip(_graph_tables(spark, d), ("nodes", "edges")))
    contents = written(_contents(spark, d), "contents")
    index = written(graph.entity_index(node.filter("type = 'document'").select("id"), contents.withColumnRenamed("content", "text")), "entities")
    ranks = graph.pagerank(node, edge)
    return node, cut(graph_search.search(_questions(spark, d), node, edge, index, ranks, contents))


@query
def graph_search_top(spark, d):
    return _graph_hits(spark, d)[1].drop("preview")


@query
def graph_search_filtered(spark, d):
    """Documents of 2024 only, with their neighbours."""
    node, edge = map(cut, _graph_tables(spark, d))
    ranks = node.select("id", F.lit(0.0).alias("rank"))
    found = graph_search.search(_questions(spark, d), node, edge, cut(_entity_index(spark, d)), ranks, cut(_contents(spark, d)), expand=False, doc_type="document", dates=("2024-01-01", "2024-01-31"))
    return graph_search.related(found, edge).select("query_id", "id", "rank_no", "graph_score", F.array_join("related", " | ").alias("related"))


@query
def similar_documents(spark, d):
    index = _entity_index(spark, d)
    starts = index.select("id").distinct().filter(F.pmod(F.conv(F.substring(F.md5("id"), 1, 6), 16, 10).cast("bigint"), F.lit(20)) == 0)
    return graph_search.similar_documents(index, starts)


# streaming


@query
def stream_latest(spark, d):
    return ingest.latest_elements(spark, f"{d}/elements.parquet")
