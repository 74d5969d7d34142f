"""Problem 4: the k most similar vectors of every vector.

Method as dealt: randomly rotated one-bit codes. The residual of a vector to its cell's centre is
rotated; its packed signs and a few correction scalars give an estimate of inner products with an
error bound, and only the vectors whose upper bound passes are compared exactly.

similar_in_cells links every vector with those over a required cosine: cells of about `cell_rows`
vectors keep the work per vector constant, and what meets in a cell is codes (8 bytes per 64
dimensions and rotation), queries of one byte a dimension, and scalars, never the vectors. knn_scan compares a
stated query set with all rows in blocks. Equal vectors are one entry with its smallest row numbers, so
copies cost nothing.

What reaches the driver: the sample the centres are fitted on (2 * sample_rows vectors at most) and the
bytes of one bitmap (bitmaps.MOST bits at most); both bounds hold at any size of the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from korpusline.functions.session import cut, spread, written
from korpusline.llm import bitmaps


@dataclass(frozen=True)
class KnnConfig:
    """k: neighbours; min_cosine: cosine that linked vectors have at least; cell_rows: vectors of a cell;
    probes: cells a query visits; sample_rows: vectors the centres are fitted on, at most (every row is
    indexed); max_cells: bound of the broadcast centres; rotations: one-bit codes of a vector; bound: standard errors by which an estimate may
    be off in similar_in_cells, scan_bound: in knn_scan; block_rows: stored rows of one block of work,
    query_rows: queries of one."""

    k: int = 5
    min_cosine: float = 0.90
    cell_rows: int = 400
    probes: int = 5
    sample_rows: int = 20_000
    max_cells: int = 20_000
    rotations: int = 2
    bound: float = 3.0
    scan_bound: float = 1.3
    block_rows: int = 8192
    query_rows: int = 65_536
    seed: int = 11


def rotation(dim: int, seed: int, count: int = 1) -> np.ndarray:
    """Random orthogonal matrices side by side; each gives one bit per dimension."""
    rng = np.random.default_rng(seed)
    parts = []
    for _ in range(count):
        q, r = np.linalg.qr(rng.normal(size=(dim, dim)))
        parts.append(q * np.sign(np.diag(r)))
    return np.concatenate(parts, axis=1).astype(np.float32)


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-30)


def centres(sample: np.ndarray, cells: int, seed: int, rounds: int = 5) -> np.ndarray:
    """Spherical k-means over the sample."""
    rng = np.random.default_rng(seed)
    cells = min(cells, len(sample))
    found = sample[rng.choice(len(sample), cells, replace=False)]
    for _ in range(rounds if cells > 1 else 0):
        nearest = np.concatenate([np.argmax(part @ found.T, axis=1) for part in np.array_split(sample, len(sample) // 4096 + 1)])
        order = np.argsort(nearest, kind="stable")
        kept, starts = np.unique(nearest[order], return_index=True)
        total = sample[rng.choice(len(sample), cells)]
        total[kept] = np.add.reduceat(sample[order], starts, axis=0)
        found = unit(total).astype(np.float32)
    return found


def isometry(dim: int, seed: int, count: int) -> np.ndarray:
    """rotation() scaled so that lengths and products stay what they are, in dim * count coordinates."""
    return rotation(dim, seed, count) / np.float32(np.sqrt(count))


def codes(rest: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed signs of the rotated residuals, lengths of the residuals, correction scalars).

    The correction scalar is the product of the code, as a unit vector, with the residual's direction.
    """
    turned = rest @ turn
    length = np.linalg.norm(rest, axis=1)
    along = np.abs(turned).sum(axis=1) / np.sqrt(turn.shape[1]) / np.maximum(length, 1e-12)
    return np.packbits(turned > 0, axis=1, bitorder="little"), length, along


def estimates(signs: np.ndarray, length: np.ndarray, along: np.ndarray, turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(estimated products of residuals, standard error of each stored row's per unit of query length).

    signs: +-1 per stored row and coordinate; turned: rotated residuals of queries, one row each. The
    product of a query with the code, over the code's correction scalar, is an unbiased estimate; its error comes
    from the part of the residual that is orthogonal to the code.
    """
    dim = signs.shape[1]
    scale = length / np.maximum(along, 1e-6)
    product = (turned @ signs.T) * (scale / np.float32(np.sqrt(dim)))[None, :]
    error = length * np.sqrt(np.maximum(1 - along**2, 0)) / np.maximum(along, 1e-6) / np.sqrt(max(dim - 1, 1))
    return product, error


def unit_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vec) of the rows with a usable vector, scaled to length 1.

    Null vectors, vectors of length 0, and vectors with a null or non-finite entry take no part.
    """
    kind = rows.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            if not len(values):
                continue
            width = len(values) // batch.num_rows
            vectors = values.reshape(-1, width)
            norm = np.linalg.norm(vectors, axis=1)
            good = np.isfinite(norm) & (norm > 0)
            # rounded, so that vectors that differ only in length become equal
            scaled = np.round(vectors[good] / norm[good, None], 6).astype(np.float32) + np.float32(0)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(scaled.ravel()), width).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), lists], ["key", "vec"])

    usable = rows.filter(F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull()))
    return spread(usable.select(F.col(key).alias("key"), F.col(vector).alias("vec"))).mapInArrow(run, f"key {kind}, vec array<float>")


def entries(vectors: DataFrame, cfg: KnnConfig) -> DataFrame:
    """(field, vid, vec, keys): each different vector once, with its k + 1 smallest keys, which are all
    that any row can have as neighbours there.

    The rank limit is applied before the shuffle too, so no task gets all copies of a vector.
    """
    rank = F.dense_rank().over(Window.partitionBy("field", "vid").orderBy("key"))
    least = vectors.withColumn("vid", F.xxhash64("vec")).withColumn("n", rank).filter(F.col("n") <= cfg.k + 1)
    return least.groupBy("field", "vid").agg(F.first("vec").alias("vec"), F.array_sort(F.collect_set("key")).alias("keys"))


@dataclass(frozen=True)
class Cells:
    """The centres of one field, and into how many blocks each cell's stored vectors and queries are cut."""

    points: np.ndarray
    blocks: np.ndarray
    asked: np.ndarray


def fitted_cells(held: DataFrame, cfg: KnnConfig) -> dict[str, Cells]:
    """Cells of each field, fitted on a sample by hash of about cfg.sample_rows vectors.

    A cell that the sample shows to hold far more than its share is cut into blocks, so that no task
    gets a group of unbounded size.
    """
    out = {}
    for name, n in sorted((r["field"], r["count"]) for r in held.groupBy("field").count().collect()):
        number = max(1, min(cfg.max_cells, n // cfg.cell_rows))
        share = min(1.0, cfg.sample_rows / n)
        chosen = held.filter((F.col("field") == name) & (F.pmod(F.xxhash64("vid", F.lit(cfg.seed)), F.lit(1 << 20)) <= int(share * (1 << 20))))
        table = chosen.select("vec").limit(2 * cfg.sample_rows).toArrow()
        if not table.num_rows:
            continue
        sample = np.ascontiguousarray(table.column(0).combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1))
        points = centres(sample, number, cfg.seed)
        size = np.bincount(np.argmax(sample @ points.T, axis=1), minlength=len(points)) * (n / len(sample))
        probed = np.bincount(np.argsort(-(sample @ points.T), axis=1)[:, : cfg.probes].ravel(), minlength=len(points)) * (n / len(sample))
        out[name] = Cells(points, *(np.ceil(np.maximum(x, 1) / most).astype(np.int64) for x, most in ((size, cfg.block_rows), (probed, cfg.query_rows))))
    return out


#: The bits of a group's number that hold the blocks of stored vectors and of queries.
BLOCK_BITS = 20


def _groups(cell: np.ndarray, blocks: np.ndarray, others: np.ndarray, ids: np.ndarray, queries: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, group): each row in its own block against all blocks of the other side of its cell."""
    row = np.repeat(np.arange(len(ids)), others)
    other = np.arange(len(row)) - np.repeat(np.cumsum(others) - others, others)
    own = (ids % blocks)[row]
    stored, asked = (other, own) if queries else (own, other)
    return row, (cell[row] << BLOCK_BITS | stored) << BLOCK_BITS | asked


def _coded(held: DataFrame, cells: dict[str, Cells], cfg: KnnConfig) -> DataFrame:
    """(field, group, vid, code): each vector in its own cell, and as a query in the cfg.probes nearest.

    code: the role (0 stored, 1 query), the length of the residual to that cell's centre, the product
    with the centre and the correction scalar as 32-bit floats, then the packed bits; of a query its
    residual in one byte a dimension, and the scalar is the step of these.
    """
    sent = held.sparkSession.sparkContext.broadcast(cells)

    def rows_of(name: str, ids: np.ndarray, group: np.ndarray, role: int, scalars: list[np.ndarray], body: np.ndarray, row: np.ndarray) -> pa.RecordBatch:
        packed = np.concatenate([np.full((len(ids), 1), role, np.uint8), np.stack(scalars, 1).astype(np.float32).view(np.uint8), body.view(np.uint8)], axis=1)[row]
        code = pa.FixedSizeBinaryArray.from_buffers(pa.binary(packed.shape[1]), len(row), [None, pa.py_buffer(np.ascontiguousarray(packed))]).cast(pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([name] * len(row)), pa.array(group), pa.array(ids[row]), code], ["field", "group", "vid", "code"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields = np.array(batch.column(0).to_pylist(), object)
            vids = batch.column(1).to_numpy()
            vectors = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1)
            for name in sorted(set(fields)):
                own = fields == name
                mine, ids, cell_of = vectors[own], vids[own], sent.value[name]
                turn = isometry(mine.shape[1], cfg.seed, cfg.rotations)
                near = mine @ cell_of.points.T
                probes = min(cfg.probes, near.shape[1])
                best = np.argpartition(-near, probes - 1, axis=1)[:, :probes]
                best = np.take_along_axis(best, np.argsort(-np.take_along_axis(near, best, 1), axis=1), 1)
                for rank in range(probes):
                    cell = best[:, rank].astype(np.int64)
                    rest = mine - cell_of.points[cell]
                    dot = np.take_along_axis(near, cell[:, None], 1)[:, 0]
                    stored, asked = cell_of.blocks[cell], cell_of.asked[cell]
                    if rank == 0:
                        bits, length, along = codes(rest, turn)
                        row, group = _groups(cell, stored, asked, ids, False)
                        yield rows_of(name, ids, group, 0, [length, dot, along], bits, row)
                    step = np.maximum(np.abs(rest).max(axis=1), 1e-12) / 127
                    row, group = _groups(cell, asked, stored, ids, True)
                    yield rows_of(name, ids, group, 1, [np.linalg.norm(rest, axis=1), dot, step], np.round(rest / step[:, None]).astype(np.int8), row)

    return held.select("field", "vid", "vec").mapInArrow(run, "field string, group bigint, vid bigint, code binary")


def candidates(coded: DataFrame, dim: int, cfg: KnnConfig) -> DataFrame:
    """Distinct (field, vid_a, vid_b) whose estimated cosine, with its error bound, may reach cfg.min_cosine."""

    def run(table: pa.Table) -> pa.Table:
        rows, vid = table.column("code").to_pylist(), table.column("vid").to_numpy()
        role = np.array([code[0] for code in rows])
        s, q = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(s) and len(q):
            held, asked = (np.frombuffer(b"".join(rows[k] for k in own), np.uint8).reshape(len(own), -1) for own in (s, q))
            (length, dot, along), (span, own_dot, step) = (np.ascontiguousarray(x[:, 1:13]).view(np.float32).T for x in (held, asked))
            turn = isometry(dim, cfg.seed, cfg.rotations)
            signs = np.unpackbits(held[:, 13:], axis=1, bitorder="little")[:, : turn.shape[1]].astype(np.float32) * 2 - 1
            turned = (np.ascontiguousarray(asked[:, 13:]).view(np.int8).astype(np.float32) * step[:, None]) @ turn
            for part in np.array_split(np.arange(len(q)), len(q) * len(s) // 4_000_000 + 1):
                product, error = estimates(signs, length, along, turned[part])
                # cosine = product of the residuals + what both have along the centre - the centre's own length
                reach = product + cfg.bound * span[part][:, None] * error[None, :] + step[part][:, None] + (own_dot[part][:, None] + dot[None, :]) >= cfg.min_cosine + 1 - 1e-4
                a, b = np.nonzero(reach)
                a, b = vid[q[part[a]]], vid[s[b]]
                left.append(np.minimum(a, b)[a != b])
                right.append(np.maximum(a, b)[a != b])
        left, right = np.concatenate(left), np.concatenate(right)
        name = table.column("field")[0].as_py()
        return pa.table({"field": pa.array([name] * len(left), pa.string()), "vid_a": left, "vid_b": right})

    return coded.groupBy("field", "group").applyInArrow(run, "field string, vid_a bigint, vid_b bigint").distinct()


def fetched(held: DataFrame, pairs: DataFrame) -> DataFrame:
    """(field, vid, vec) of the vectors in the pairs, and few others: a bitmap keeps the rest from the shuffle."""
    sent = held.sparkSession.sparkContext.broadcast(bitmaps.of_keys(pairs.select(F.explode(F.array("vid_a", "vid_b")).alias("vid")).distinct()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(bitmaps.has(sent.value, batch.column(1).to_numpy())))

    return held.select("field", "vid", "vec").mapInArrow(run, "field string, vid bigint, vec array<float>")


def exact(pairs: DataFrame, held: DataFrame, cfg: KnnConfig) -> DataFrame:
    """(field, vid_a, vid_b, cosine) of the pairs that reach cfg.min_cosine, from the vectors themselves."""
    vectors = fetched(held, pairs)
    a = vectors.select("field", F.col("vid").alias("vid_a"), F.col("vec").alias("vec_a"))
    b = vectors.select("field", F.col("vid").alias("vid_b"), F.col("vec").alias("vec_b"))
    joined = pairs.join(a, ["field", "vid_a"]).join(b, ["field", "vid_b"]).select("field", "vid_a", "vid_b", "vec_a", "vec_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(k).flatten().to_numpy().astype(np.float64).reshape(batch.num_rows, -1) for k in (3, 4))
            cosine = np.round((x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1)), 6)
            kept = pa.array(cosine >= cfg.min_cosine)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).filter(kept) for k in range(3)), pa.array(cosine).filter(kept)], ["field", "vid_a", "vid_b", "cosine"])

    return joined.mapInArrow(run, "field string, vid_a bigint, vid_b bigint, cosine double")


def similar_in_cells(vectors: DataFrame, cfg: KnnConfig = KnnConfig()) -> DataFrame:
    """(field, key, other, cosine, rank): for every row its neighbours of rank 1 to k among those with a
    cosine of at least cfg.min_cosine in the same field; equal cosines: smaller key first.

    vectors: field, key, vec as unit_vectors makes them. Equal vectors have the cosine 1. A repeated
    key counts once; an empty table gives no rows. Pairs whose vectors share none of the visited
    cells are missed (the README has the recall measured at sf0.1, with 23 and 24 cells); nothing else is left out.
    """
    held = written(entries(vectors, cfg), "vectors")
    cells = fitted_cells(held, cfg)
    dim = next((c.points.shape[1] for c in cells.values()), 1)
    pairs = cut(candidates(_coded(held, cells, cfg), dim, cfg))
    near = cut(exact(pairs, held, cfg))
    both = near.unionByName(near.select("field", F.col("vid_a").alias("vid_b"), F.col("vid_b").alias("vid_a"), "cosine"))
    keys = held.select("field", F.col("vid").alias("vid_b"), "keys")
    offered = both.join(keys, ["field", "vid_b"]).select("field", F.col("vid_a").alias("vid"), "keys", "cosine")
    own = held.filter(F.size("keys") > 1).select("field", "vid", "keys", F.lit(1.0).alias("cosine"))
    lists = offered.unionByName(own).select("field", "vid", "cosine", F.explode("keys").alias("other"))
    best = lists.withColumn("n", F.row_number().over(Window.partitionBy("field", "vid").orderBy(F.desc("cosine"), "other"))).filter(F.col("n") <= cfg.k + 1)
    members = vectors.select("field", F.xxhash64("vec").alias("vid"), "key").distinct()
    joined = members.join(best.select("field", "vid", "other", "cosine"), ["field", "vid"]).filter("key <> other")
    ranked = joined.withColumn("rank", F.row_number().over(Window.partitionBy("field", "key").orderBy(F.desc("cosine"), "other")))
    return ranked.filter(F.col("rank") <= cfg.k).select("field", "key", "other", "cosine", "rank")


def neighbour_pairs(vectors: DataFrame, cfg: KnnConfig = KnnConfig()) -> DataFrame:
    """(field, row_a, row_b), row_a < row_b: one of the two is among the neighbours of the other."""
    return similar_in_cells(vectors, cfg).select("field", F.least("key", "other").alias("row_a"), F.greatest("key", "other").alias("row_b")).distinct()


def knn_scan(queries: DataFrame, vectors: DataFrame, cfg: KnnConfig = KnnConfig()) -> DataFrame:
    """(field, key, other, cosine, rank): the k nearest of all rows for every query, whatever the cosine.

    queries and vectors: field, key, vec. Both are cut into blocks; each pair of blocks is one group,
    in which one-bit codes with their correction scalars choose the rows that are compared exactly.
    The work is queries times rows by definition; only the best k per block are passed on.
    """
    held = vectors.select("field", "key", "vec")
    counts = {r["field"]: r["count"] for r in held.groupBy("field").count().collect()}
    asked = {r["field"]: r["count"] for r in queries.groupBy("field").count().collect()}
    stores = F.create_map(*[F.lit(x) for f, n in counts.items() for x in (f, n // cfg.block_rows + 1)] or [F.lit(""), F.lit(1)])
    asks = F.create_map(*[F.lit(x) for f, n in asked.items() for x in (f, n // cfg.block_rows + 1)] or [F.lit(""), F.lit(1)])
    number = F.xxhash64("key")

    def blocked(rows: DataFrame, role: int) -> DataFrame:
        mine, other = (stores, asks) if role == 0 else (asks, stores)
        block = rows.withColumn("mine", F.pmod(number, F.coalesce(mine[F.col("field")], F.lit(1)))).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(other[F.col("field")], F.lit(1)) - 1)))
        a, b = ("mine", "other") if role == 0 else ("other", "mine")
        return block.select("field", F.col(a).cast("bigint").alias("s"), F.col(b).cast("bigint").alias("a"), "key", "vec", F.lit(role).cast("tinyint").alias("role"))

    def run(table: pa.Table) -> pa.Table:
        role = table.column("role").to_numpy()
        keys = table.column("key").to_numpy()
        vecs = table.column("vec").combine_chunks().flatten().to_numpy().reshape(len(role), -1)
        out: list[tuple] = []
        s, q = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        if len(s) and len(q):
            turn = isometry(vecs.shape[1], cfg.seed, 1)
            centre = vecs[s].mean(axis=0)
            bits, length, along = codes(vecs[s] - centre, turn)
            sign = np.unpackbits(bits, axis=1, bitorder="little")[:, : turn.shape[1]].astype(np.float32) * 2 - 1
            for part in np.array_split(q, len(q) * len(s) // 4_000_000 + 1):
                turned = vecs[part] @ turn
                product, error = estimates(sign, length, along, turned)
                estimate = product + (vecs[part] @ centre)[:, None]
                half = cfg.scan_bound * np.linalg.norm(turned, axis=1)[:, None] * error[None, :]
                k = min(cfg.k + 1, len(s))
                least = -np.partition(half - estimate, k - 1, axis=1)[:, k - 1]
                for row, (i, floor) in enumerate(zip(part, least)):
                    chosen = np.flatnonzero(estimate[row] + half[row] >= floor)
                    cosine = np.round(vecs[s[chosen]].astype(np.float64) @ vecs[i].astype(np.float64), 6)
                    other = keys[s[chosen]]
                    keep = other != keys[i]
                    order = np.lexsort((other[keep], -cosine[keep]))[: cfg.k]
                    out += [(keys[i], o, c) for o, c in zip(other[keep][order], cosine[keep][order])]
        cols = list(zip(*out)) or [[], [], []]
        return pa.table({"field": pa.array([table.column("field")[0].as_py()] * len(out), pa.string()), "key": pa.array(cols[0], pa.int64()), "other": pa.array(cols[1], pa.int64()), "cosine": pa.array(cols[2], pa.float64())})

    met = blocked(held, 0).unionByName(blocked(queries.select("field", "key", "vec"), 1)).groupBy("field", "s", "a").applyInArrow(run, "field string, key bigint, other bigint, cosine double")
    rank = F.row_number().over(Window.partitionBy("field", "key").orderBy(F.desc("cosine"), "other"))
    return met.withColumn("rank", rank).filter(F.col("rank") <= cfg.k)


def fields_of(rows: DataFrame) -> DataFrame:
    """(field, key, vec) of the heading and path vectors of doc_fields_npz."""
    return unit_vectors(rows, "row_no", "heading_vec").select(F.lit("heading").alias("field"), "key", "vec").unionByName(unit_vectors(rows, "row_no", "path_vec").select(F.lit("path").alias("field"), "key", "vec"))
