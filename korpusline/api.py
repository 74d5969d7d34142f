"""The engine's entry points, all from DataFrames to DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from korpusline.config import ChunkConfig, ContextConfig, GraphConfig, RerankConfig, SearchConfig
from korpusline.functions import vectors as vc
from korpusline.functions.session import cut, written
from korpusline.operators import chunking, context, entities, fields, graph, graph_search, ranking, rerank, search
from korpusline.sources import files


class Engine:
    """Ingest, index and search. Queries are DataFrames (query_id, query)."""

    def __init__(self, spark: SparkSession, search_config: SearchConfig = SearchConfig(), graph_config: GraphConfig = GraphConfig()):
        self.spark, self.config, self.graph_config = spark, search_config, graph_config

    def ingest(self, root: str) -> DataFrame:
        """Elements of all supported files below a folder."""
        return files.elements_of(files.scan(self.spark, root))

    def chunk(self, elements: DataFrame, cfg: ChunkConfig = ChunkConfig()) -> DataFrame:
        return chunking.build_chunks(elements, cfg)

    def index(self, chunks: DataFrame) -> DataFrame:
        return search.index(chunks)

    def doc_fields(self, elements: DataFrame) -> DataFrame:
        return fields.doc_fields(elements)

    def lexicon(self, doc_fields: DataFrame) -> DataFrame:
        return fields.lexicon(doc_fields)

    def search_raw(self, queries: DataFrame, indexed: DataFrame, top_k: int = 10, oversample: int = 5, categories=None, doc_ids=None, doc_paths=None, heading_prefixes=None, min_score=None) -> DataFrame:
        found = search.search_raw(queries, indexed, top_k, oversample, categories=categories, doc_ids=doc_ids, doc_paths=doc_paths, heading_prefixes=heading_prefixes, min_score=min_score)
        return search.hits_by_document(found)

    def search(self, queries: DataFrame, indexed: DataFrame, top_k: int = 10, oversample: int = 5, window: int = 1, category=None, doc_id=None, doc_path=None, heading_prefix=None) -> DataFrame:
        """Documents with neighbour windows; limits as in the service: top_k 1–100, oversample 1–20, window 0–5."""
        if not (1 <= top_k <= 100 and 1 <= oversample <= 20 and 0 <= window <= 5):
            raise ValueError("top_k must be in 1..100, oversample in 1..20, window in 0..5")
        return search.search_window(queries, indexed, top_k, oversample, window, categories=category, doc_ids=doc_id, doc_paths=doc_path, heading_prefixes=heading_prefix)

    def search_universal(self, queries: DataFrame, indexed: DataFrame, doc_fields: DataFrame, top_k: int | None = None, use_entities: bool = True, use_graph: bool = True, use_reranker: bool = False, graph_results: DataFrame | None = None, categories: str | None = None) -> DataFrame:
        """Fused documents, or with use_reranker their reranked hits.

        graph_results: as graph_merge takes them, used where use_graph; categories: a comma list, applied
        after the cut (results of the graph alone have the category `graph`).
        """
        cfg = self.config
        found = cut(search.search_raw(queries, indexed, cfg.semantic_top_k, cfg.oversample))  # for the scores, and again for the hits
        dense = found.groupBy("query_id", "doc_key").agg(F.max("score").alias("dense"))
        scored = ranking.fuse(dense, queries, doc_fields, fields.lexicon(doc_fields), cfg, keep=("category", "heading_text"))
        bonus: Column = F.lit(0.0)
        if use_entities:
            scored = scored.join(entities.extract(queries).select("query_id", "domain", "object_attributes"), "query_id", "left")
            bonus = cfg.weights.entity * ranking.entity_bonus(F.col("domain"), F.col("object_attributes"))
        scored = scored.withColumn("score", F.round(F.col("fused") + bonus, 6))
        ranked = ranking.graph_merge(scored.select("query_id", "doc_key", "score"), graph_results, cfg.weights.graph) if use_graph and graph_results is not None else scored.select("query_id", "doc_key", "score", F.lit("text").alias("origin"))
        best = search.best(ranked, top_k or cfg.top_k_docs, F.desc("score"), F.col("doc_key"))
        wanted = [c.strip() for c in (categories or "").split(",") if c.strip()]
        if wanted:
            category = F.when(F.col("origin") == "graph", "graph").otherwise(F.split("doc_key", "::", 2)[0])
            best = best.filter(category.isin(*wanted))
        if not use_reranker:
            return best
        best = cut(best)
        hits = found.drop("rank").join(best.select("query_id", "doc_key"), ["query_id", "doc_key"]).join(queries.select("query_id", "query"), "query_id")
        return rerank.rerank(hits, top_k or cfg.top_k_docs, cfg.max_chunks_per_doc)

    def rerank(self, hits: DataFrame, top_k_docs: int = 5, max_chunks_per_doc: int = 4, cfg: RerankConfig = RerankConfig(), pair_score: Column | None = None) -> DataFrame:
        return rerank.rerank(hits, top_k_docs, max_chunks_per_doc, cfg, pair_score)

    def context(self, reranked: DataFrame, cfg: ContextConfig = ContextConfig()) -> DataFrame:
        return context.pack(context.items(reranked), cfg)

    def context_quality(self, reranked: DataFrame) -> DataFrame:
        return context.quality(context.items(reranked))

    def extract_entities(self, queries: DataFrame, stations: DataFrame | None = None) -> DataFrame:
        return entities.extract(queries, stations)

    def build_graph(self, elements: DataFrame) -> Graph:
        rows = written(graph.prepared(elements), "elements")  # read for all kinds of nodes and edges
        return Graph(graph.nodes(rows), graph.edges(rows), self.graph_config)

    def encode(self, rows: DataFrame, text: str = "text") -> DataFrame:
        return rows.withColumn("vec", vc.encode(text))


class Graph:
    """Nodes and edges with their queries."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, cfg: GraphConfig = GraphConfig()):
        self.nodes, self.edges, self.cfg = nodes, edges, cfg

    def analyze_hierarchy(self) -> DataFrame:
        return graph.analysis(self.nodes, self.edges)

    def get_relevant_sections(self, queries: DataFrame, top_k: int = 5) -> DataFrame:
        return graph.relevant_sections(queries, self.nodes.filter("type = 'section'"), top_k)

    def get_structural_path(self, source: str, target: str) -> DataFrame:
        return graph.shortest_path(self.edges, source, target)

    def get_related_nodes(self, ids: DataFrame, max_distance: int = 2) -> DataFrame:
        return graph.neighbourhood(ids, self.edges, max_distance)

    def get_node_importance(self) -> DataFrame:
        return graph.node_importance(self.nodes, graph.pagerank(self.nodes, self.edges, self.cfg))

    def entity_index(self, texts: DataFrame) -> DataFrame:
        return graph.entity_index(self.nodes, texts)

    def find_nodes_by_entities(self, index: DataFrame, kind: str, value: str) -> DataFrame:
        return index.filter((F.col("kind") == kind) & (F.col("value") == value)).select("id")

    def find_nodes_by_domain(self, index: DataFrame, domain: str) -> DataFrame:
        return self.find_nodes_by_entities(index, "domain", domain)

    def search(self, queries: DataFrame, index: DataFrame, contents: DataFrame, top_k: int = 10, expand_graph: bool = True, **conditions) -> DataFrame:
        ranks = graph.pagerank(self.nodes, self.edges, self.cfg)
        return graph_search.search(queries, self.nodes, self.edges, index, ranks, contents, top_k, expand_graph, self.cfg, **conditions)

    def search_graph(self, queries: DataFrame, index: DataFrame, contents: DataFrame, top_k: int = 10, **conditions) -> DataFrame:
        """search() with up to five neighbours of every result."""
        return graph_search.related(self.search(queries, index, contents, top_k, **conditions), self.edges)

    def save(self, path: str) -> None:
        """Nodes and edges as two parquet tables below the path."""
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        self.edges.write.mode("overwrite").parquet(f"{path}/edges")

    @classmethod
    def load(cls, spark: SparkSession, path: str, cfg: GraphConfig = GraphConfig()) -> Graph:
        return cls(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"), cfg)

    def find_similar_documents(self, index: DataFrame, starts: DataFrame, top_k: int = 5) -> DataFrame:
        return graph_search.similar_documents(index, starts, top_k)

    def get_document_hierarchy(self, roots: DataFrame, depth: int | None = None) -> DataFrame:
        return graph.hierarchy(self.edges, roots, depth)

    def node(self, ids: DataFrame) -> DataFrame:
        """Attributes of the nodes, with the first ten nodes within two hops."""
        near = graph.neighbourhood(ids, self.edges, 2)
        first = search.best(near, 10, F.col("distance"), F.col("id"), by="start").groupBy(F.col("start").alias("id")).agg(F.array_sort(F.collect_list(F.struct("distance", "id"))).alias("near"))
        return self.nodes.join(ids.select("id"), "id", "left_semi").join(first, "id", "left")
