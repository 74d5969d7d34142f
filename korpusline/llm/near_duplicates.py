"""Problem 3: near-duplicate texts, found without comparing all with all.

Method as dealt: min-max hashing. Each permutation gives two signature values, the least and the
greatest hash of the text's shingles, so half as many permutations are evaluated; the values are
cut into bands, and texts that agree in a band are candidates. Candidates are compared exactly.

What is shuffled: one row of (band hash, id hash), 16 bytes, per band and distinct text; then only
the texts of candidates. A band value that very many texts share is not expanded into all its
pairs: such texts meet by an exact prefix filter instead, over shingles from the rarest on, which finds
every pair over the threshold. Counts of bands and of equal texts are aggregations, so no hot value is
one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from korpusline.functions.session import cut, spread
from korpusline.llm import bitmaps
from korpusline.llm.words import WordHashes, mix, shingles, words


@dataclass(frozen=True)
class NearConfig:
    """shingle: successive words; threshold: least Jaccard similarity; bands of `rows` values each from
    bands * rows / 2 permutations; hot: texts of a band value above which the prefix filter pairs them."""

    shingle: int = 5
    threshold: float = 0.8
    bands: int = 32
    rows: int = 5
    hot: int = 200
    seed: int = 7

    @property
    def permutations(self) -> int:
        return self.bands * self.rows // 2

    def miss(self, similarity: float) -> float:
        """Expected share of pairs of this similarity that no band joins."""
        return (1 - similarity**self.rows) ** self.bands


def batch_shingles(texts: list[str], size: int, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    tokens: list[str] = []
    lengths = np.zeros(len(texts), np.int64)
    for n, text in enumerate(texts):
        own = words(text)
        lengths[n] = len(own)
        tokens += own
    return shingles(hashes.of(tokens), lengths, size)


def minmax_signatures(values: np.ndarray, counts: np.ndarray, cfg: NearConfig) -> np.ndarray:
    """One row per text that has shingles: under each permutation the least and the greatest value."""
    starts = (np.cumsum(counts) - counts)[counts > 0]
    factors = np.random.default_rng(cfg.seed).integers(1, 1 << 63, (cfg.permutations, 2), dtype=np.uint64)
    out = np.zeros((len(starts), 2 * cfg.permutations), np.uint64)
    for p, (factor, offset) in enumerate(factors):
        permuted = (values ^ offset) * (factor | np.uint64(1))
        permuted ^= permuted >> np.uint64(32)
        permuted *= factor | np.uint64(1)
        out[:, p] = np.minimum.reduceat(permuted, starts)
        out[:, cfg.permutations + p] = np.maximum.reduceat(permuted, starts)
    return out


def band_hashes(signatures: np.ndarray, cfg: NearConfig) -> np.ndarray:
    """One 64-bit value per band; the band's number is mixed in, so one column serves as the join key.

    A band takes values of different permutations: the minimum and the maximum of the same one stay apart.
    """
    out = np.zeros((len(signatures), cfg.bands), np.uint64)
    for band in range(cfg.bands):
        value = np.full(len(signatures), band + 1, np.uint64)
        for row in range(cfg.rows):
            value = mix(value + signatures[:, band * cfg.rows + row])
        out[:, band] = value
    return out


def banded(texts: DataFrame, cfg: NearConfig) -> DataFrame:
    """(key, bands) of every text class with at least one shingle, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            values, counts = batch_shingles(batch.column(1).to_pylist(), cfg.shingle, hashes)
            keys = band_hashes(minmax_signatures(values, counts, cfg), cfg).view(np.int64)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), cfg.bands).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(counts > 0)), lists], ["key", "bands"])

    return texts.select("key", "text").mapInArrow(run, "key bigint, bands array<bigint>").dropDuplicates(["key"])


def _hot_pairs(hot: DataFrame, texts: DataFrame, cfg: NearConfig) -> DataFrame:
    """Candidates among the texts of hot bands: pairs that share one of the shingles in their prefixes.

    With shingles in one fixed order, two sets of similarity t share an element among the first
    |S| - ceil(t |S|) + 1 of each, so no pair is lost. The order is by how many of the texts hold a
    shingle: what all of them hold, such as a common beginning, comes last and joins nothing.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            values, counts = batch_shingles(list(batch.text), cfg.shingle, hashes)
            at = np.cumsum(counts) - counts
            yield pd.DataFrame({"key": batch.key, "size": counts, "shingles": [values[a : a + n].view(np.int64) for a, n in zip(at, counts)]})

    sets = cut(texts_of(hot.select("key"), texts).mapInPandas(run, "key bigint, size bigint, shingles array<bigint>"))
    each = sets.select("key", "size", F.explode("shingles").alias("shingle"))
    held = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1")
    # shingles of one text come first in the order and meet no other text
    own = Window.partitionBy("key")
    place = F.col("size") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("texts", "shingle"))
    prefix = F.col("size") - F.ceil(F.col("size") * cfg.threshold - 1e-9) + 1
    token = each.join(held, "shingle").withColumn("place", place).filter(F.col("place") <= prefix).select("key", "size", "shingle")
    a, b = token.alias("a"), token.alias("b")
    return a.join(b, (F.col("a.shingle") == F.col("b.shingle")) & (F.col("a.key") < F.col("b.key")) & (F.col("a.size") >= cfg.threshold * F.col("b.size")) & (F.col("b.size") >= cfg.threshold * F.col("a.size"))).select(
        F.col("a.key").alias("key_a"), F.col("b.key").alias("key_b")
    )


def texts_of(keys: DataFrame, texts: DataFrame) -> DataFrame:
    """(key, text) of the given keys, once each; a bitmap keeps most other texts out of the shuffle, and the join decides."""
    sent = texts.sparkSession.sparkContext.broadcast(bitmaps.of_keys(keys.select("key").distinct()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(bitmaps.has(sent.value, batch.column(0).to_numpy())))

    near = texts.select("key", "text").mapInArrow(run, "key bigint, text string")
    return near.join(keys.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.min("text").alias("text"))


def shared_bands(bands: DataFrame) -> DataFrame:
    """(key, band, n) of the band values that n > 1 texts have. bands: key, bands; checkpointed."""
    counts = cut(bands.select(F.explode("bands").alias("band")).groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    sent = bands.sparkSession.sparkContext.broadcast(bitmaps.of_keys(counts.select("band")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # most band values belong to one text only and stay here
        for batch in batches:
            if batch.num_rows:
                values = batch.column(1).flatten().to_numpy()
                keep = bitmaps.has(sent.value, values)
                keys = np.repeat(batch.column(0).to_numpy(), len(values) // batch.num_rows)
                yield pa.RecordBatch.from_arrays([pa.array(keys[keep]), pa.array(values[keep])], ["key", "band"])

    return bands.mapInArrow(run, "key bigint, band bigint").join(counts, "band").select("key", "band", "n")


def candidate_pairs(texts: DataFrame, cfg: NearConfig) -> DataFrame:
    """Distinct (key_a, key_b) of texts that agree in a band."""
    shared = cut(shared_bands(cut(banded(texts, cfg))))
    some = shared.filter(F.col("n") <= cfg.hot)
    a, b = some.alias("a"), some.alias("b")
    pairs = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.key") < F.col("b.key"))).select(F.col("a.key").alias("key_a"), F.col("b.key").alias("key_b"))
    hot = shared.filter(F.col("n") > cfg.hot).select("key").distinct()
    if not hot.isEmpty():
        pairs = pairs.unionByName(_hot_pairs(hot, texts, cfg))
    return pairs.distinct()


def verified(pairs: DataFrame, texts: DataFrame, cfg: NearConfig) -> DataFrame:
    """(key_a, key_b, similarity) of the pairs whose texts reach the threshold."""
    held = texts_of(pairs.select(F.explode(F.array("key_a", "key_b")).alias("key")), texts)
    both = pairs.join(held.select(F.col("key").alias("key_b"), F.col("text").alias("text_b")), "key_b").join(held.select(F.col("key").alias("key_a"), F.col("text").alias("text_a")), "key_a").select("key_a", "key_b", "text_a", "text_b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            values, counts = batch_shingles([*batch.text_a, *batch.text_b], cfg.shingle, hashes)
            n, at = len(batch), np.cumsum(counts) - counts
            similar = np.zeros(n)
            for k in range(n):
                common = len(np.intersect1d(values[at[k] : at[k] + counts[k]], values[at[n + k] : at[n + k] + counts[n + k]], assume_unique=True))
                similar[k] = common / max(1, counts[k] + counts[n + k] - common)
            keep = similar >= cfg.threshold
            yield pd.DataFrame({"key_a": batch.key_a[keep], "key_b": batch.key_b[keep], "similarity": similar[keep]})

    return both.mapInPandas(run, "key_a bigint, key_b bigint, similarity double")


@dataclass(frozen=True)
class NearDuplicates:
    """members: (id, key, text class) of every text with a shingle; links: (key_a, key_b, similarity) between different texts."""

    members: DataFrame
    links: DataFrame


def near_duplicates(rows: DataFrame, cfg: NearConfig = NearConfig()) -> NearDuplicates:
    """Similar texts of a table (id string, text string; further columns are ignored).

    Equal texts form one class (members) and are compared once, through the class; links join
    different texts. A class is named by a 64-bit hash of its text. Null texts, and texts with fewer
    words than a shingle, have no shingles and take no part. A repeated id counts once. An empty table
    gives empty results.
    """
    # possessive, and from the start of a word only: linear in the text, whatever it holds
    several = r"(?<![\p{L}\p{N}])[\p{L}\p{N}]++(?:[^\p{L}\p{N}]++[\p{L}\p{N}]++){%d}" % (cfg.shingle - 1)
    texts = spread(rows.select("id", "text").filter(F.col("text").rlike(several))).select("id", F.xxhash64("text").alias("key"), "text")
    pairs = cut(candidate_pairs(texts, cfg))
    return NearDuplicates(texts.select("id", "key").distinct(), verified(pairs, texts, cfg))


def similar_pairs(rows: DataFrame, cfg: NearConfig = NearConfig()) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of ids at or over the threshold, equal texts included.

    This form lists the pairs inside a group of equal texts too, as its result is defined so;
    near_duplicate_groups gives one row per text instead.
    """
    found = near_duplicates(rows, cfg)
    links = found.links.select("key_a", "key_b")
    members = found.members
    between = links.join(members.select(F.col("key").alias("key_a"), F.col("id").alias("x")), "key_a").join(members.select(F.col("key").alias("key_b"), F.col("id").alias("y")), "key_b").select("x", "y")
    several = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    copied = members.join(several, "key", "left_semi")
    within = copied.select("key", F.col("id").alias("x")).join(copied.select("key", F.col("id").alias("y")), "key").filter("x < y").select("x", "y")
    return between.unionByName(within).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(key, root): connected components of (key_a, key_b), by alternating large and small stars.

    A large star ties the greater neighbours of a key to the least key it knows, a small star its lesser
    ones; both keep what is connected so. The loop ends when every key has one edge, to a key that has
    none: the rounds grow with the logarithm of a component's size, whatever its diameter. Only whether
    there are other keys reaches the driver.
    """
    links = cut(links.select("key_a", "key_b").distinct())
    edges = cut(links.filter("key_a <> key_b").select(F.greatest("key_a", "key_b").alias("key"), F.least("key_a", "key_b").alias("other")).distinct())
    while True:
        both = edges.union(edges.select("other", "key"))
        least = both.groupBy("key").agg(F.least(F.min("other"), F.col("key")).alias("least"))
        large = both.filter("other > key").join(least, "key").select(F.col("other").alias("key"), F.col("least").alias("other")).distinct()
        least = large.groupBy("key").agg(F.min("other").alias("least"))
        small = large.join(least, "key").filter("other > least").select("other", "least").union(least)
        edges = cut(small.toDF("key", "other").distinct())
        several = edges.groupBy("key").count().filter("count > 1").select("key")
        inner = edges.select("key").join(edges.select(F.col("other").alias("key")), "key", "left_semi")
        if several.union(inner).isEmpty():
            break
    keys = links.select(F.explode(F.array("key_a", "key_b")).alias("key")).distinct()
    return keys.join(edges, "key", "left").select("key", F.coalesce("other", "key").alias("root"))


def near_duplicate_groups(rows: DataFrame, cfg: NearConfig = NearConfig()) -> DataFrame:
    """(id, group_id, links): one row per distinct id with a text class; links counts the other texts similar to its own."""
    found = near_duplicates(rows, cfg)
    links = cut(found.links.select("key_a", "key_b"))
    degree = links.select(F.explode(F.array("key_a", "key_b")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("links"))
    return (
        found.members.join(components(links), "key", "left")
        .join(degree, "key", "left")
        .select("id", F.coalesce("root", "key").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
    )
