"""The property graph of folders, documents, sections and elements, and queries on it.

Nodes and edges are two tables. Iterations (PageRank, paths, trees) checkpoint to the shared folder
every round, and only counts reach the driver. Several tables come from the same elements: `prepared`
elements, written once, may be given to all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korpusline.config import GraphConfig
from korpusline.functions import text as tx
from korpusline.functions.session import cut, written
from korpusline.operators.fields import keyed

#: Rows (edges between nodes with out-edges, and these nodes) up to which the rounds of PageRank are one task of a few hundred MB.
CORE_ROWS = 1_000_000


def folder_prefixes(category: str | Column) -> Column:
    """(path, name, level, parent) of every prefix of a category path."""
    parts = F.filter(F.split(F.coalesce(F.regexp_replace(tx.col(category), r"\\", "/"), F.lit("")), "/"), lambda x: x != "")
    steps = F.when(F.size(parts) > 0, F.sequence(F.lit(1), F.size(parts))).otherwise(F.array().cast("array<int>"))
    join = lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")
    return F.transform(steps, lambda n: F.struct(join(n).alias("path"), F.get(parts, n - 1).alias("name"), (n - 1).alias("level"), F.when(n > 1, join(n - 1)).alias("parent")))


def once(elements: DataFrame, *columns: str) -> DataFrame:
    """Elements with keys, each id once; prepared ones are as they are."""
    return elements if "has_path" in elements.columns else keyed(elements.select(*columns))


def prepared(elements: DataFrame) -> DataFrame:
    """Elements with keys, section number and heading, each id once."""
    if "has_path" in elements.columns:
        return elements
    dated = F.to_date("parsed_at") if "parsed_at" in elements.columns else F.lit(None).cast("date")
    elements = elements.withColumn("date", dated)
    rows = keyed(elements.select("id", "category", "doc_id", "doc_path", "page", "elem_order", "element_type", "text", "media_path", "headings_path", "date"))
    number = tx.section_number(F.coalesce("text", F.lit("")))
    return rows.withColumn("has_path", F.size(F.coalesce("headings_path", F.array().cast("array<string>"))) > 0).withColumn("section", F.coalesce(number, F.concat(F.lit("section_"), F.substring("id", 1, 8))))


def section_importance(elements: DataFrame) -> DataFrame:
    """(doc_key, section, elements, importance): 0.3 * count + 0.4 * min(length / 1000, 1) + 0.3 * (tables, formulas and images); `general` without a number."""
    rows = once(elements, "id", "category", "doc_id", "doc_path", "element_type", "text")
    own = rows.withColumn("section", F.coalesce(tx.section_number(F.coalesce("text", F.lit(""))), F.lit("general")))
    special = F.count_if(F.col("element_type").isin("table", "formula", "image"))
    length = F.coalesce(F.sum(F.length("text")), F.lit(0))
    return own.groupBy("doc_key", "section").agg(F.count(F.lit(1)).alias("elements"), F.round(0.3 * F.count(F.lit(1)) + 0.4 * F.least(length / 1000, F.lit(1.0)) + 0.3 * special, 6).alias("importance"))


def folder_nodes(elements: DataFrame) -> DataFrame:
    steps = elements.select("category").distinct().select(F.explode(folder_prefixes("category")).alias("f")).select("f.*").distinct()
    return steps.select(F.concat(F.lit("folder::"), "path").alias("id"), F.lit("folder").alias("type"), "name", "path", "level", F.round(1 / (F.col("level") + 1), 6).alias("importance"), "parent")


def document_nodes(elements: DataFrame) -> DataFrame:
    rows = prepared(elements)
    docs = rows.groupBy("doc_key").agg(F.count(F.lit(1)).alias("element_count"), F.min("category").alias("category"), F.min("doc_path").alias("path"), F.min("date").alias("date"))
    return docs.select(F.concat(F.lit("document::"), "doc_key").alias("id"), F.lit("document").alias("type"), "doc_key", "category", "path", "element_count", "date")


def section_nodes(elements: DataFrame) -> DataFrame:
    """One node per document and section of elements with a heading path; the first element names it."""
    rows = prepared(elements).filter("has_path")
    first = F.struct(F.coalesce("page", F.lit(0)), F.coalesce("elem_order", F.lit(0)), "id")
    found = rows.groupBy("doc_key", "section").agg(F.min_by(F.struct(F.substring("text", 1, 100).alias("heading"), tx.hierarchy_level("headings_path").alias("level")), first).alias("x"), F.count(F.lit(1)).alias("element_count"))
    weight = section_importance(elements).select("doc_key", "section", "importance")
    return found.join(weight, ["doc_key", "section"], "left").select(F.concat(F.lit("section::"), "doc_key", F.lit("::"), "section").alias("id"), F.lit("section").alias("type"), "doc_key", F.col("section").alias("name"), F.col("x.heading").alias("heading"), F.col("x.level").alias("level"), "element_count", F.coalesce("importance", F.lit(0.5)).alias("importance"))


def element_nodes(elements: DataFrame) -> DataFrame:
    rows = prepared(elements).filter("has_path")
    return rows.select(F.concat(F.lit("element::"), "id").alias("id"), F.col("element_type").alias("type"), "doc_key", "section", "page", "elem_order", F.coalesce(F.length("text"), F.lit(0)).alias("text_length"), F.col("media_path").isNotNull().alias("has_media"))


def nodes(elements: DataFrame) -> DataFrame:
    """All nodes: id, type, name, path, doc_key, level, importance, category, element_count, date, heading, page, elem_order, text_length, has_media."""
    parts = [folder_nodes(elements).drop("parent"), document_nodes(elements), section_nodes(elements), element_nodes(elements).drop("section")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def reference_edges(elements: DataFrame) -> DataFrame:
    """(src, dst): sections that refer to other sections of their document; both ends must exist."""
    rows = prepared(elements)
    refs = rows.select("doc_key", "section", F.explode(tx.references("text")).alias("target")).distinct()
    known = section_nodes(elements).select("doc_key", F.col("name").alias("section"), "id")
    a = known.withColumnRenamed("id", "src")
    b = known.select("doc_key", F.col("section").alias("target"), F.col("id").alias("dst"))
    return refs.join(a, ["doc_key", "section"]).join(b, ["doc_key", "target"]).select("src", "dst").distinct()


def edges(elements: DataFrame) -> DataFrame:
    """(src, dst, rel, weight): refines, contains, has_section, contains_element, references."""
    folders = folder_nodes(elements).filter("parent is not null").select(F.concat(F.lit("folder::"), "parent").alias("src"), F.col("id").alias("dst"), F.lit("refines").alias("rel"), F.lit(1.0).alias("weight"))
    whole = F.array_join(F.filter(F.split(F.regexp_replace("category", r"\\", "/"), "/"), lambda x: x != ""), "/")
    docs = document_nodes(elements).filter(F.coalesce(F.col("category"), F.lit("")) != "").select(F.concat(F.lit("folder::"), whole).alias("src"), F.col("id").alias("dst"), F.lit("contains").alias("rel"), F.lit(1.0).alias("weight"))
    sections = section_nodes(elements).select(F.concat(F.lit("document::"), "doc_key").alias("src"), F.col("id").alias("dst"), F.lit("has_section").alias("rel"), F.col("importance").alias("weight"))
    parts = element_nodes(elements).select(F.concat(F.lit("section::"), "doc_key", F.lit("::"), "section").alias("src"), F.col("id").alias("dst"), F.lit("contains_element").alias("rel"), F.lit(1.0).alias("weight"))
    refs = reference_edges(elements).select("src", "dst", F.lit("references").alias("rel"), F.lit(0.8).alias("weight"))
    return folders.unionByName(docs).unionByName(sections).unionByName(parts).unionByName(refs)


def analysis(node: DataFrame, edge: DataFrame) -> DataFrame:
    """(kind, value, n): nodes by type, edges by relation, and the deepest section level."""
    types = node.groupBy("type").count().select(F.lit("nodes").alias("kind"), F.col("type").alias("value"), F.col("count").alias("n"))
    rels = edge.groupBy("rel").count().select(F.lit("edges").alias("kind"), F.col("rel").alias("value"), F.col("count").alias("n"))
    deep = node.filter("type = 'section'").agg(F.coalesce(F.max("level"), F.lit(0)).cast("bigint").alias("n")).select(F.lit("depth").alias("kind"), F.lit("section").alias("value"), "n")
    return types.unionByName(rels).unionByName(deep)


def document_analysis(sections: DataFrame, references: DataFrame, most: int = 5) -> DataFrame:
    """(doc_key, sections, mean_importance, top_sections, references): per document; the most important sections first.

    sections: as section_nodes makes them; references: src, dst between sections.
    """
    refs = references.join(sections.select(F.col("id").alias("src"), "doc_key"), "src").groupBy("doc_key").agg(F.count(F.lit(1)).alias("references"))
    rank = F.row_number().over(Window.partitionBy("doc_key").orderBy(F.desc("importance"), "name"))
    top = F.array_sort(F.collect_list(F.when(F.col("n") <= most, F.struct("n", "name"))))
    each = sections.withColumn("n", rank).groupBy("doc_key").agg(F.count(F.lit(1)).alias("sections"), F.round(F.avg("importance"), 6).alias("mean_importance"), F.array_join(F.transform(top, lambda x: x["name"]), ", ").alias("top_sections"))
    return each.join(refs, "doc_key", "left").withColumn("references", F.coalesce("references", F.lit(0)))


def top_sections(sections: DataFrame, most: int = 5) -> DataFrame:
    """(doc_key, section, importance, rank): the most important sections of each document."""
    rank = F.row_number().over(Window.partitionBy("doc_key").orderBy(F.desc("importance"), "section"))
    return sections.withColumn("rank", rank).filter(F.col("rank") <= most).select("doc_key", "section", "importance", "rank")


def relevant_sections(queries: DataFrame, sections: DataFrame, most: int = 5) -> DataFrame:
    """(query_id, id, score, rank): sections by shared words times importance; only those that share one."""
    asked = queries.select("query_id", F.explode(F.array_distinct(tx.words("query"))).alias("word"))
    said = sections.select("id", "importance", F.explode(F.array_distinct(tx.words("heading"))).alias("word"))
    scored = asked.join(said, "word").groupBy("query_id", "id", "importance").agg(F.count(F.lit(1)).alias("overlap")).withColumn("score", F.round(F.col("overlap") * F.col("importance"), 6))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= most).select("query_id", "id", "score", "rank")


def pagerank(node: DataFrame, edge: DataFrame, cfg: GraphConfig = GraphConfig()) -> DataFrame:
    """(id, rank) after cfg.iterations rounds: r' = (1 - d) / N + d * (sum of r * w / out-weight + dangling / N).

    Only nodes with out-edges pass rank on: the rounds run over these, what the others hold is one number,
    and the last round gives the rank of all. Up to CORE_ROWS rows the rounds are one task; beyond it each is a join.
    A node with very many edges is no single task then: contributions are added up before the shuffle.
    """
    ids = node.select("id").distinct()
    n = max(ids.count(), 1)
    if cfg.iterations < 1:
        return ids.select("id", F.round(F.lit(1.0 / n), 9).alias("rank"))
    out = edge.groupBy("src").agg(F.sum("weight").alias("out"))
    linked = out.join(ids.select(F.col("id").alias("src")), "src", "left_semi")
    share = written(edge.select("src", "dst", "weight").join(linked, "src").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", (F.col("weight") / F.col("out")).alias("p")), "share")
    met = share.join(linked.select(F.col("src").alias("dst"), F.lit(True).alias("on")), "dst", "left")
    # a row per edge between linked nodes, and one per linked node with the share that it gives to the others
    apart = linked.select("src").join(met.filter("`on` is null").groupBy("src").agg(F.sum("p").alias("p")), "src", "left")
    core = written(met.filter("`on`").select("src", "dst", "p").unionByName(apart.select("src", F.lit(None).cast("string").alias("dst"), F.coalesce("p", F.lit(0.0)).alias("p"))), "core")
    nodes_, rows = core.agg(F.count_if(F.col("dst").isNull()), F.count(F.lit(1))).first()
    state, idle = (_rounds_in_one_task if rows <= CORE_ROWS else _rounds_by_joins)(core, n, n - nodes_, cfg)
    flow = share.join(state.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("p")).alias("flow"))
    return ids.join(flow, "id", "left").select("id", F.round((1 - cfg.damping) / n + cfg.damping * (F.coalesce("flow", F.lit(0.0)) + idle / n), 9).alias("rank"))


def _idle(moved: float, idle: float, n: int, others: int, cfg: GraphConfig) -> float:
    """What nodes without out-edges hold after one more round, `moved` being what the linked ones give them."""
    return others * (1 - cfg.damping) / n + cfg.damping * (moved + others * idle / n)


def _rounds_in_one_task(core: DataFrame, n: int, others: int, cfg: GraphConfig) -> tuple[DataFrame, float]:
    """(id, rank) of the linked nodes before the last round, and what the others hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        rows = pa.Table.from_batches(got)
        bare = pc.is_null(rows.column("dst"))
        own, edges_ = rows.filter(bare), rows.filter(pc.invert(bare))
        ids, apart = own.column("src").combine_chunks(), own.column("p").to_numpy()
        src, dst = (pc.index_in(edges_.column(c), ids).to_numpy() for c in ("src", "dst"))
        p = edges_.column("p").to_numpy()
        rank, idle = np.full(len(ids), 1.0 / n), others / n
        for _ in range(cfg.iterations - 1):
            flow = np.bincount(dst, rank[src] * p, len(ids))
            rank, idle = (1 - cfg.damping) / n + cfg.damping * (flow + idle / n), _idle(float(rank @ apart), idle, n, others, cfg)
        yield pa.RecordBatch.from_arrays([ids, pa.array(rank)], ["id", "rank"])
        yield pa.RecordBatch.from_arrays([pa.array([None], ids.type), pa.array([idle])], ["id", "rank"])

    done = cut(core.repartition(1).mapInArrow(run, f"id {core.schema['src'].dataType.simpleString()}, rank double"))
    held = done.filter("id is null").first()
    # without a linked node the others share all
    return done.filter("id is not null"), held["rank"] if held else others / n


def _rounds_by_joins(core: DataFrame, n: int, others: int, cfg: GraphConfig) -> tuple[DataFrame, float]:
    """As _rounds_in_one_task, a checkpoint each round."""
    edge, idle = core.filter("dst is not null"), others / n
    state = cut(core.filter("dst is null").select(F.col("src").alias("id"), F.col("p").alias("apart"), F.lit(1.0 / n).alias("rank")))
    for _ in range(cfg.iterations - 1):
        flow = edge.join(state.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("p")).alias("flow"))
        moved = state.agg(F.coalesce(F.sum(F.col("rank") * F.col("apart")), F.lit(0.0))).first()[0]
        state = cut(state.drop("rank").join(flow, "id", "left").select("id", "apart", ((1 - cfg.damping) / n + cfg.damping * (F.coalesce("flow", F.lit(0.0)) + idle / n)).alias("rank")))
        idle = _idle(moved, idle, n, others, cfg)
    return state.select("id", "rank"), idle


def node_importance(node: DataFrame, ranks: DataFrame) -> DataFrame:
    """(id, importance): the base (0.5 without one); with more than 10 nodes 0.7 * base + 0.3 * PageRank."""
    total = node.agg(F.count(F.lit(1)).alias("n"))
    base = F.coalesce("importance", F.lit(0.5))
    return node.join(ranks, "id").crossJoin(F.broadcast(total)).select("id", F.round(F.when(F.col("n") > 10, 0.7 * base + 0.3 * F.col("rank")).otherwise(base), 6).alias("importance"))


def neighbourhood(starts: DataFrame, edge: DataFrame, hops: int = 2) -> DataFrame:
    """(start, id, distance): nodes within so many out-edges of each start, at their least distance, the start left out."""
    front = starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("distance"))
    seen = front
    for hop in range(1, hops + 1):
        front = front.join(edge.select(F.col("src").alias("id"), "dst"), "id").select("start", F.col("dst").alias("id"), F.lit(hop).alias("distance")).distinct()
        seen = seen.unionByName(front)
    return seen.groupBy("start", "id").agg(F.min("distance").alias("distance")).filter("start <> id")


def shortest_path(edge: DataFrame, source: str, target: str) -> DataFrame:
    """(step, id) along one shortest directed path, the least by node ids; empty without one.

    The search goes on until the target is met or no new node is, whatever the length of the path.
    """
    spark = edge.sparkSession
    front = spark.createDataFrame([(source, [source])], "id string, path array<string>")
    seen = front.select("id")
    while not front.isEmpty():
        hit = front.filter(F.col("id") == target)
        if not hit.isEmpty():
            return hit.select(F.posexplode("path").alias("step", "id"))
        step = front.join(edge.select(F.col("src").alias("id"), "dst"), "id").groupBy(F.col("dst").alias("id")).agg(F.min(F.concat("path", F.array("dst"))).alias("path"))
        front = cut(step.join(seen, "id", "left_anti"))
        seen = cut(seen.union(front.select("id")))
    return front.select(F.posexplode("path").alias("step", "id"))


def hierarchy(edge: DataFrame, roots: DataFrame, depth: int | None = None) -> DataFrame:
    """(root, id, parent, depth): what the roots contain, to the last level or to the depth asked for.

    Over containment edges only: they form a forest, so cycles of references don't matter and the levels end.
    """
    own = edge.filter(F.col("rel") != "references").select(F.col("src").alias("id"), "dst")
    level = roots.select(F.col("id").alias("root"), "id", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"))
    out, d = level, 0
    while depth is None or d < depth:
        d += 1
        level = cut(level.select("root", "id").join(own, "id").select("root", F.col("dst").alias("id"), F.col("id").alias("parent"), F.lit(d).alias("depth")))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def entity_index(node: DataFrame, texts: DataFrame) -> DataFrame:
    """(kind, value, id): the inverted index of entities over document nodes. texts: id (of the node), text."""
    from korpusline.operators import entities as en

    rows = texts.join(node.select("id"), "id", "left_semi")
    # outer, as Spark finds an exploded column twice otherwise: it first asks whether it is empty
    return rows.select("id", F.explode_outer(en.labelled("text")).alias("x")).filter("x is not null").select("x.kind", "x.value", "id").distinct()
