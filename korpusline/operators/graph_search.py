"""Search on the graph: candidates by entities, scores, expansion, similar documents."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korpusline.config import GraphConfig
from korpusline.functions import text as tx
from korpusline.functions.session import cut, written
from korpusline.operators import entities as en
from korpusline.operators import graph as gr
from korpusline.operators.search import BROADCAST_QUERIES

# Weight of each kind of entity in a match.
KINDS = {"domain": 0.3, "object_attributes": 0.2, "actors": 0.2, "identifiers": 0.3}


def query_entities(queries: DataFrame) -> DataFrame:
    """(query_id, kind, value) of the queries' entities."""
    return queries.select("query_id", F.explode_outer(en.labelled("query")).alias("x")).filter("x is not null").select("query_id", "x.kind", "x.value").distinct()


def candidates(queries: DataFrame, index: DataFrame, cfg: GraphConfig = GraphConfig()) -> tuple[DataFrame, DataFrame]:
    """((query_id, id) of the nodes that share an entity, the query_ids with fewer than cfg.fewest_candidates of them)."""
    found = query_entities(queries).join(index, ["kind", "value"]).select("query_id", "id").distinct()
    enough = found.groupBy("query_id").count().filter(F.col("count") >= cfg.fewest_candidates).select("query_id")
    return found, queries.select("query_id").join(enough, "query_id", "left_anti")


def _worded(queries: DataFrame) -> DataFrame:
    return queries.withColumn("words", F.filter(F.split(F.lower("query"), r"\s+"), lambda w: w != ""))


def _matched(queries: DataFrame, nodes: DataFrame, index: DataFrame, most: int, cfg: GraphConfig) -> DataFrame:
    """(query_id, id, type, graph_score): the `most` best of each query among the nodes that share an entity with it, or among all documents and sections where fewer than cfg.fewest_candidates do.

    nodes: id, type, base (the part of the score that does not depend on the query), content. Every node meets all
    queries in Arrow batches, and of each block of nodes only a query's best go on, scored as node_score() does. Nodes
    without content and entities have only the base, so the best of them are the same for every query.
    """
    spark = queries.sparkSession
    asked = queries.select("query_id", "words").filter("words is not null").toArrow().combine_chunks()  # a null query has no score
    ids = asked.column(0).combine_chunks()
    held = index.groupBy("id").agg(F.collect_list(F.struct("kind", "value")).alias("entities"))
    met = nodes.withColumn("known", F.lit(True)).join(held, "id", "full")  # ids that only the index has count as matches, but are no results
    wanted = F.col("entities").isNotNull() | F.col("content").isNotNull() & F.col("type").isin("document", "section")
    sent = spark.sparkContext.broadcast(Asked(ids, asked.column(1).to_pylist(), [(r.query_id, r.kind, r.value) for r in query_entities(queries).collect()]))
    k = most * max(Counter(ids.to_pylist()).values(), default=1)
    size = max(1, min(BLOCK, 1_000_000 // max(1, len(ids))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows if len(sent.value.ids) else 0, size):
                yield from sent.value.best(batch.slice(at, size), k)

    kinds = {f.name: f.dataType.simpleString() for f in (*queries.schema, *nodes.schema)}
    full = met.filter(wanted).select("id", "type", "base", F.lower("content").alias("low"), "entities", F.coalesce("known", F.lit(False)).alias("known"))
    # part: m of those that share an entity, a of all documents and sections, n counts the first
    spread = full.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))  # work by node, whatever their bytes
    found = written(spread.mapInArrow(run, f"part string, query_id {kinds['query_id']}, id {kinds['id']}, type string, graph_score double, n bigint"), "found")
    enough = found.filter("part = 'n'").groupBy("query_id").agg(F.sum("n").alias("n")).filter(F.col("n") >= cfg.fewest_candidates).select("query_id")
    few = queries.filter("words is not null").select("query_id").join(enough, "query_id", "left_anti")
    bare = nodes.filter(F.col("type").isin("document", "section") & F.col("content").isNull()).withColumn("graph_score", F.round("base", 6)).orderBy(F.desc("graph_score"), "id").limit(k)
    same = few.crossJoin(F.broadcast(bare.select("id", "type", "graph_score")))
    rows = found.filter("part = 'm'").unionByName(found.filter("part = 'a'").join(few.distinct(), "query_id", "left_semi")).select("query_id", "id", "type", "graph_score")
    # a node of both parts, or one without content that shares an entity, has its best score
    return rows.unionByName(same).filter("graph_score > 0").groupBy("query_id", "id", "type").agg(F.max("graph_score").alias("graph_score"))


#: Nodes that meet all queries at once: a few arrays of so many times the queries.
BLOCK = 1024
#: A piece of content without blanks is looked up by its parts up to this length, else searched for every word.
LONG = 2000


def rounded(x: np.ndarray, places: int) -> np.ndarray:
    """Half up on the decimal digits, as Spark's round does on doubles, times 10 ** places."""
    scaled = x * 10.0**places
    out = np.floor(scaled + 0.5)
    near = np.abs(scaled - np.floor(scaled) - 0.5) < 1e-5
    if near.any():
        values, back = np.unique(x[near], return_inverse=True)
        unit = Decimal(1).scaleb(-places)
        out[near] = np.array([float(Decimal(repr(float(v))).quantize(unit, ROUND_HALF_UP).scaleb(places)) for v in values])[back.ravel()]
    return out


class Asked:
    """Queries as postings: of each word and entity the queries that have it."""

    def __init__(self, ids: pa.Array, words: list[list[str]], entities: list[tuple]):
        self.ids, by_word, places = ids, defaultdict(list), defaultdict(list)
        for n, (q, own) in enumerate(zip(ids.to_pylist(), words)):
            places[q].append(n)
            for w in own:
                by_word[w].append(n)
        self.words = {w: np.array(v) for w, v in by_word.items()}
        self.lengths = sorted({len(w) for w in by_word})
        self.sizes = np.array([len(x) for x in words], float)
        self.entities: dict = {}
        self.asked = {k: np.zeros(len(ids)) for k in KINDS}
        for q, kind, value in entities:
            for n in places.get(q, ()):
                self.entities.setdefault((kind, value), []).append(n)
                self.asked[kind][n] += 1
        self.firsts = [v[0] for v in places.values()]
        self.seen: dict[str, list[str]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"seen": {}}

    def within(self, piece: str) -> list[str]:
        """The words that occur in a piece without blanks."""
        found = self.seen.get(piece)
        if found is None:
            if len(piece) > LONG:
                found = [w for w in self.words if w in piece]
            else:
                parts = {piece[i : i + n] for n in self.lengths if n <= len(piece) for i in range(len(piece) - n + 1)}
                found = [w for w in parts if w in self.words]
            if len(self.seen) >= 200_000:
                self.seen.clear()
            if len(piece) < 100:
                self.seen[piece] = found
        return found

    def shares(self, low: list[str | None]) -> np.ndarray:
        """Of each content the share of the queries' words that it has; words hold no blanks, so each lies within one piece."""
        out = np.zeros((len(low), len(self.ids)))
        for row, text in enumerate(low):
            found = {w for piece in set(BLANKS.split(text or "")) if piece for w in self.within(piece)}
            if found:
                out[row] = np.bincount(np.concatenate([self.words[w] for w in found]), minlength=len(self.ids))
        return out / np.where(self.sizes > 0, self.sizes, 1)

    def matches(self, entities: list) -> tuple[np.ndarray, np.ndarray]:
        """(whether an entity is shared, match as entity_match finds it) by node and query."""
        shape = len(entities), len(self.ids)
        weight, share, total = np.zeros(shape), np.zeros(shape), np.zeros(shape)
        for kind, part in KINDS.items():
            common, has = np.zeros(shape), np.zeros(shape[0], bool)
            for row, own in enumerate(entities):
                for x in own or ():
                    if x["kind"] == kind:
                        has[row] = True
                        common[row, self.entities.get((kind, x["value"]), [])] += 1
            agreed = common > 0
            weight += part * agreed
            share += agreed if kind in ("domain", "identifiers") else common / np.where(self.asked[kind] > 0, self.asked[kind], 1)
            total += has[:, None] & (self.asked[kind] > 0)[None, :]
        return weight > 0, rounded(np.minimum(1.0, weight * share / np.where(total > 0, total, 1)), 9) / 1e9

    def best(self, batch: pa.RecordBatch, k: int) -> Iterator[pa.RecordBatch]:
        batch = batch.take(pc.sort_indices(batch.column("id")))  # ties go to the lower id
        known, base = batch.column("known").to_numpy(zero_copy_only=False).astype(bool), batch.column("base").to_numpy(zero_copy_only=False).astype(float)
        met, match = self.matches(batch.column("entities").to_pylist())
        score = np.zeros(met.shape, np.int64)
        if known.any():
            score[known] = rounded(base[known, None] + 0.5 * match[known] + 0.2 * self.shares([x for x, y in zip(batch.column("low").to_pylist(), known) if y]), 6)
        whole = pc.fill_null(pc.is_in(batch.column("type"), pa.array(["document", "section"])), False).to_numpy(zero_copy_only=False).astype(bool)
        ids, one = self.ids, len(self.firsts)
        yield pa.RecordBatch.from_arrays([pa.array(["n"] * one), ids.take(pa.array(self.firsts)), pa.nulls(one, batch.column("id").type), pa.nulls(one, pa.string()), pa.nulls(one, pa.float64()), pa.array(met.sum(axis=0)[self.firsts].astype(np.int64))], OUT)
        place = np.arange(batch.num_rows)[::-1, None]
        for part, may in (("m", met & known[:, None]), ("a", np.broadcast_to((whole & known)[:, None], met.shape))):
            # one number tells the order: the score, then the place
            key = np.where(may & (score > 0), score * BLOCK + place, -1)
            if len(key) > k:
                row = np.argpartition(key, len(key) - k, axis=0)[len(key) - k :]
            else:
                row = np.broadcast_to(np.arange(len(key))[:, None], key.shape)
            query = np.broadcast_to(np.arange(len(ids))[None, :], row.shape)
            kept = key[row, query] >= 0
            row, query = row[kept], query[kept]
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(row), pa.string()), ids.take(pa.array(query)), batch.column("id").take(pa.array(row)), batch.column("type").take(pa.array(row)), pa.array(score[row, query] / 1e6), pa.nulls(len(row), pa.int64())], OUT)


OUT = ["part", "query_id", "id", "type", "graph_score", "n"]
BLANKS = re.compile(r"[ \t\n\x0b\f\r]+")


def filtered(rows: DataFrame, doc_type: str | None = None, dates: tuple[str, str] | None = None, path_prefix: str | None = None) -> DataFrame:
    """Graph filters: node type, a date between two dates (ISO strings, both included), a path prefix. Nodes without the property don't match."""
    if doc_type:
        rows = rows.filter(F.col("type") == doc_type)
    if dates:
        rows = rows.filter(F.col("date").between(*[F.lit(d).cast("date") for d in dates]))
    return rows.filter(F.startswith("path", F.lit(path_prefix))) if path_prefix else rows


def entity_match(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(query_id, id, match) of the pairs that share an entity.

    The weights of the kinds in which they agree, times matches / kinds that both have. A kind matches by the share
    of the query's values that the node has; domain and identifiers match as a whole. 1 at most.
    """
    asked = query_entities(queries)
    size = asked.groupBy("query_id", "kind").agg(F.count(F.lit(1)).alias("asked"))
    common = asked.join(index, ["kind", "value"]).groupBy("query_id", "id", "kind").agg(F.count(F.lit(1)).alias("common")).join(size, ["query_id", "kind"])
    weight = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[F.col("kind")]
    share = F.when(F.col("kind").isin("domain", "identifiers"), 1.0).otherwise(F.col("common") / F.col("asked"))
    agreed = common.groupBy("query_id", "id").agg(F.sum(weight).alias("weight"), F.sum(share).alias("matches"))
    both = agreed.select("query_id", "id").join(size.select("query_id", "kind"), "query_id").join(index.select("id", "kind").distinct(), ["id", "kind"])
    total = both.groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("total"))
    return agreed.join(total, ["query_id", "id"]).select("query_id", "id", F.round(F.least(F.lit(1.0), F.col("weight") * F.col("matches") / F.col("total")), 9).alias("match"))


def node_score() -> Column:
    """0.2 * importance + 0.1 * PageRank + 0.5 * entity match + 0.2 * share of query words in the content."""
    return F.round(0.2 * F.coalesce("importance", F.lit(0.5)) + 0.1 * F.coalesce("rank", F.lit(0.0)) + 0.5 * F.coalesce("match", F.lit(0.0)) + 0.2 * tx.word_hit_ratio("query", "content"), 6)


def scored(pairs: DataFrame, asked: DataFrame, info: DataFrame, match: DataFrame) -> DataFrame:
    """pairs (query_id, id) with `graph_score`."""
    return pairs.join(asked, "query_id").join(info, "id").join(match, ["query_id", "id"], "left").withColumn("graph_score", node_score())


def search(queries: DataFrame, node: DataFrame, edge: DataFrame, index: DataFrame, ranks: DataFrame, contents: DataFrame, top: int = 10, expand: bool = True, cfg: GraphConfig = GraphConfig(), **conditions) -> DataFrame:
    """(query_id, id, type, graph_score, hops, rank_no, preview): the best nodes, and nodes near the first five.

    A node near one of these has its own score, divided by one more than the distance and discounted. contents: id,
    content. Scores must be positive; a node keeps its best score.
    """
    info = written(node.select("id", "type", "importance").join(ranks, "id", "left").join(contents, "id", "left"), "info")
    asked = queries.select("query_id", "query")
    base = (0.2 * F.coalesce("importance", F.lit(0.5)) + 0.1 * F.coalesce("rank", F.lit(0.0))).alias("base")
    most = max(top, cfg.expand_from)  # no other node can be a result or lead to one
    if asked.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES:
        rest = info.join(filtered(node, **conditions).select("id"), "id", "left_semi") if any(conditions.values()) else info
        found = _matched(_worded(asked), rest.select("id", "type", base, "content"), index, most, cfg)
    else:
        met, few = candidates(queries, index, cfg)
        whole = filtered(node.filter(F.col("type").isin("document", "section")), **conditions).select("id")
        pairs = filtered(met.join(node, "id"), **conditions).select("query_id", "id").unionByName(few.crossJoin(whole)).distinct()
        found = scored(pairs, asked, info, entity_match(queries, index)).filter("graph_score > 0").select("query_id", "id", "type", "graph_score")
    order = Window.partitionBy("query_id").orderBy(F.desc("graph_score"), "id")
    found = cut(found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most).withColumn("hops", F.lit(0)))
    if expand:
        lead = found.filter(F.col("n") <= cfg.expand_from)
        near = gr.neighbourhood(lead.select("id").distinct(), edge, cfg.max_distance)
        wide = lead.select("query_id", F.col("id").alias("start")).join(near, "start").groupBy("query_id", "id").agg(F.min("distance").alias("hops"))
        wide = cut(wide.join(lead.select("query_id", "id"), ["query_id", "id"], "left_anti"))
        match = entity_match(queries, index.join(wide.select("id").distinct(), "id", "left_semi"))
        more = scored(wide, asked, info, match).withColumn("graph_score", F.round(F.col("graph_score") / (F.col("hops") + 1) * cfg.expand_decay, 6))
        found = found.drop("n").unionByName(more.filter(F.col("graph_score") > cfg.expand_least).select("query_id", "id", "type", "graph_score", "hops"))
    best = found.groupBy("query_id", "id", "type").agg(F.max("graph_score").alias("graph_score"), F.min_by("hops", F.struct(-F.col("graph_score"), "hops")).alias("hops"))
    return best.withColumn("rank_no", F.row_number().over(order)).filter(F.col("rank_no") <= top).join(contents.select("id", F.substring("content", 1, 500).alias("preview")), "id", "left")


def related(results: DataFrame, edge: DataFrame, most: int = 5) -> DataFrame:
    """Results with up to five nodes one hop away."""
    near = gr.neighbourhood(results.select("id").distinct(), edge, 1).groupBy(F.col("start").alias("id")).agg(F.slice(F.array_sort(F.collect_set("id")), 1, most).alias("related"))
    return results.join(near, "id", "left")


def similar_documents(index: DataFrame, starts: DataFrame, most: int = 5) -> DataFrame:
    """(id, other, shared, rank): for each of the stated nodes the documents by the attributes and actors they share.

    starts: id. The stated set meets the inverted index; no pairs within an entity are made for other nodes.
    """
    own = index.filter(F.col("kind").isin("object_attributes", "actors")).select("kind", "value", "id")
    asked = own.join(starts.select("id"), "id", "left_semi")
    shared = asked.join(own.withColumnRenamed("id", "other"), ["kind", "value"]).filter("id <> other").groupBy("id", "other").agg(F.count(F.lit(1)).alias("shared"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("shared"), "other"))
    return shared.withColumn("rank", rank).filter(F.col("rank") <= most)
