"""Problem 7: passages of evaluation items inside corpus documents.

Method as dealt: SimHash fingerprints of windows of items and documents. An item gives windows of
its own size (the longest of cfg.sizes that it holds, overlapping by half) and, as items also leak in
part, all windows of the shortest passage that counts. A multi-index over blocks of the fingerprint
guarantees every pair of windows within the Hamming radius: of b blocks at most `radius` differ, so two
such windows agree in some choice of b - radius blocks. Candidates are verified by the similarity of
their shingles, weighted by how rare their words are among the items.

The corpus is read once. A bitmap of the items' block keys keeps nearly all document windows where
they are; the few that pass carry their words to a join with the item windows, so no item and no
fingerprint reaches the driver, and the number of items has no bound.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korpusline.functions.session import cut, spread
from korpusline.llm import bitmaps
from korpusline.llm.words import WordHashes, mix, words


@dataclass(frozen=True)
class LeakConfig:
    """window: successive words that make a leak; sizes: lengths of the windows of whole items;
    radius: Hamming distance within which all windows are found; shingle, threshold: words of a shingle, and
    weighted similarity of two windows, at least; spare: bits of a block key beyond those that
    number the item windows; weights: slots of the hashed word weights; chunk: words handled at once."""

    window: int = 13
    sizes: tuple[int, ...] = (32, 64, 128)
    radius: int = 2
    shingle: int = 5
    threshold: float = 0.8
    spare: int = 10
    weights: int = 1 << 16
    chunk: int = 1 << 15


#: A word broken at a line end, and characters without width: taken out for a second reading.
BROKEN = re.compile(r"(?<=\w)[-‐‑¬]\s*\n\s*(?=\w)|[­​‌‍⁠﻿]")


def readings(text: str) -> list[list[str]]:
    """The words of the text, and where words are broken at line ends, those of the text with them joined."""
    out = [words(text)]
    if BROKEN.search(text):
        joined = words(BROKEN.sub("", text))
        if joined != out[0]:
            out.append(joined)
    return out


def simhashes(hashes: np.ndarray, sizes: tuple[int, ...]) -> dict[int, np.ndarray]:
    """size -> 64-bit fingerprints of all windows of so many successive words (255 at most).

    Bit j is set where more than half of the window's word hashes have it set. Eight bits are counted at
    a time, in the bytes of one 64-bit number; a window's count is put together from those of powers of two.
    """
    longest = max(sizes, default=0)
    assert longest <= 255, "a window has at most 255 words"
    lanes = np.uint64(0x0101010101010101)
    out = {size: np.zeros(max(0, len(hashes) - size + 1), np.uint64) for size in sizes}
    for bit in range(8):
        sums, width = {1: (hashes >> np.uint64(bit)) & lanes}, 1
        while 2 * width <= min(longest, len(hashes)):
            sums[2 * width] = sums[width][:-width] + sums[width][width:]
            width *= 2
        for size, found in out.items():
            if not len(found):
                continue
            total, at = np.full(len(found), lanes * np.uint64(127 - size // 2)), 0
            for power in (p for p in sorted(sums, reverse=True) if size & p):
                total += sums[power][at : at + len(found)]
                at += power
            # a byte is over size // 2 exactly if the 127 - size // 2 added to it set its top bit
            found |= ((total >> np.uint64(7)) & lanes) << np.uint64(bit)
    return out


def block_masks(blocks: int, radius: int) -> np.ndarray:
    """The bits of every choice of blocks - radius blocks; prints within the radius agree on one of them."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    runs = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return np.array([sum(chosen) for chosen in combinations(runs, blocks - radius)], np.uint64)


def blocks_for(windows: int, cfg: LeakConfig) -> int:
    """The fewest blocks whose keys have cfg.spare bits more than number the windows."""
    return next((b for b in range(cfg.radius + 1, 33) if 64 * (b - cfg.radius) / b >= math.log2(max(2, windows)) + cfg.spare), 33)


@dataclass(frozen=True)
class Index:
    """What a task needs to tell which windows may meet an item: block masks and a bitmap with two slots a key."""

    masks: np.ndarray
    sizes: tuple[int, ...]
    packed: np.ndarray

    def keys(self, prints: np.ndarray, size: int, table: int) -> np.ndarray:
        return mix((prints & self.masks[table]) + np.uint64(table * 256 + size)).view(np.int64)

    def passing(self, prints: np.ndarray, size: int, table: int) -> np.ndarray:
        """Positions whose key is probably an item's."""
        # one multiplication for the first slot: nearly all windows end there
        at = np.flatnonzero(bitmaps.set_at(self.packed, first_slots(prints & self.masks[table], size, table, 8 * len(self.packed))))
        return at[bitmaps.has(self.packed, self.keys(prints[at], size, table))] if len(at) else at


def first_slots(masked: np.ndarray, size: int, table: int, bits: int) -> np.ndarray:
    factor = np.uint64(0x9E3779B97F4A7C15 + 2 * (table * 256 + size))
    return ((masked * factor) >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)


def window_starts(length: int, cfg: LeakConfig) -> Iterator[tuple[int, int]]:
    """(size, start) of an item's windows."""
    for start in range(length - cfg.window + 1):
        yield cfg.window, start
    size = max((s for s in cfg.sizes if s <= length), default=0)
    if size:
        yield from ((size, start) for start in sorted({*range(0, length - size + 1, size // 2), length - size}))


def _item_windows(items: DataFrame, cfg: LeakConfig) -> DataFrame:
    """(id, item_id, part, size, starts, print, passage): part numbers the readings of an item's texts; a passage that an item repeats is one row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            rows = []
            for item, part, text in zip(batch.item_id, batch.part, batch.text):
                for n, own in enumerate(readings(text)):
                    prints = simhashes(hashes.of(own), (cfg.window, *cfg.sizes))
                    places: dict[tuple[int, str], list[int]] = {}
                    for size, start in window_starts(len(own), cfg):
                        places.setdefault((size, " ".join(own[start : start + size])), []).append(start)
                    rows += [(item, f"{part}:{n}", size, starts, prints[size][starts[0]].view(np.int64), passage) for (size, passage), starts in places.items()]
            yield pd.DataFrame(rows, columns=["item_id", "part", "size", "starts", "print", "passage"])

    kind = items.schema["item_id"].dataType.simpleString()
    texts = items.select("item_id", F.xxhash64("text").alias("part"), "text").filter("text is not null").distinct()
    found = spread(texts).mapInPandas(run, f"item_id {kind}, part string, size int, starts array<int>, print bigint, passage string")
    return found.withColumn("id", F.xxhash64("item_id", "part", "size", "starts"))


def word_slot(word: str, slots: int, hashes: WordHashes) -> int:
    return hashes[word] & (slots - 1)


def word_weights(items: DataFrame, cfg: LeakConfig) -> np.ndarray:
    """The weight of each slot of words: log(1 + items / (1 + items with such a word)). At most cfg.weights rows reach the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            own = Counter()
            for text in batch.text:
                own.update({word_slot(w, cfg.weights, hashes) for w in words(text)})
            own[-1] += len(batch)
            yield pd.DataFrame({"slot": list(own), "n": list(own.values())})

    seen = items.select("text").filter("text is not null").distinct().mapInPandas(run, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    slots, n = (seen.column(k).to_numpy() for k in range(2))
    df = np.zeros(cfg.weights)
    df[slots[slots >= 0]] = n[slots >= 0]
    return np.log(1 + n[slots < 0].sum() / (1 + df))


class Similarity:
    """Weighted similarity of two passages: what their shingles share, over what either has, each shingle with the mean weight of its words."""

    def __init__(self, weights: np.ndarray, cfg: LeakConfig):
        self.weights, self.cfg, self.hashes = weights, cfg, WordHashes()

    def shingles(self, passage: str) -> dict[tuple[str, ...], float]:
        own = passage.split(" ")
        value = [self.weights[word_slot(w, self.cfg.weights, self.hashes)] for w in own]
        out: dict[tuple[str, ...], float] = {}
        for k in range(max(1, len(own) - self.cfg.shingle + 1)):
            key = tuple(own[k : k + self.cfg.shingle])
            out[key] = out.get(key, 0.0) + sum(value[k : k + self.cfg.shingle]) / len(key)
        return out

    def of(self, a: str, b: str) -> float:
        if a == b:
            return 1.0
        x, y = self.shingles(a), self.shingles(b)
        shared = sum(min(v, y[k]) for k, v in x.items() if k in y)
        return shared / max(sum(x.values()) + sum(y.values()) - shared, 1e-12)


def _index(windows: DataFrame, cfg: LeakConfig) -> Index:
    """The index over checkpointed item windows; what reaches the driver is a count, the sizes in use and the bytes of the bitmap."""
    count = windows.count()
    sizes = tuple(sorted(r["size"] for r in windows.select("size").distinct().collect()))  # at most one more than cfg.sizes
    masks = block_masks(blocks_for(count, cfg), cfg.radius)
    bits = bitmaps.bits_for(2 * count * len(masks), 32)
    index = Index(masks, sizes, np.zeros(bits // 8, np.uint8))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            prints = batch["print"].to_numpy().view(np.uint64)
            for size in np.unique(batch["size"]):
                own = prints[batch["size"].to_numpy() == size]
                for table, mask in enumerate(masks):
                    yield pd.DataFrame({"slot": np.concatenate([first_slots(own & mask, int(size), table, bits), index.keys(own, int(size), table) & (bits - 1)])})

    return Index(masks, sizes, bitmaps.of_slots(windows.select("print", "size").mapInPandas(run, "slot bigint"), bits))


def _keyed(windows: DataFrame, index: Index) -> DataFrame:
    """(key, id, print): the item windows once per block key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            prints = batch["print"].to_numpy().view(np.uint64)
            for table in range(len(index.masks)):
                key = np.zeros(len(batch), np.int64)
                for size in np.unique(batch["size"]):
                    own = batch["size"].to_numpy() == size
                    key[own] = index.keys(prints[own], int(size), table)
                yield pd.DataFrame({"key": key, "id": batch["id"], "print": batch["print"]})

    return windows.select("id", "size", "print").mapInPandas(run, "key bigint, id bigint, print bigint")


def _document_windows(documents: DataFrame, sent, cfg: LeakConfig) -> DataFrame:
    """(doc_id, reading, tab, own, said, key): the document windows that pass the bitmap, with their words; those that repeat nearby once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, hashes = sent.value, WordHashes()

        def found(docs: list, numbers: list[int], tokens: list[str], lengths: list[int]) -> pd.DataFrame:
            ends = np.cumsum(lengths)
            rows: dict[tuple, None] = {}
            for size, prints in simhashes(hashes.of(tokens), index.sizes).items():
                for table in range(len(index.masks)):
                    at = index.passing(prints, size, table)
                    doc = np.searchsorted(ends, at, "right")
                    inside = at + size <= ends[doc] if len(at) else np.zeros(0, bool)
                    keys = index.keys(prints[at], size, table)
                    rows.update(((docs[d], numbers[d], table, int(prints[a].view(np.int64)), " ".join(tokens[a : a + size]), int(k)), None) for a, d, k in zip(at[inside], doc[inside], keys[inside]))
            return pd.DataFrame(list(rows), columns=["doc_id", "reading", "tab", "own", "said", "key"])

        for batch in batches:
            docs, numbers, tokens, lengths = [], [], [], []
            for doc, text in zip(batch.doc_id, batch.text):
                for n, own in enumerate(readings(text)):
                    docs.append(doc)
                    numbers.append(n)
                    tokens += own
                    lengths.append(len(own))
                if len(tokens) > cfg.chunk:
                    yield found(docs, numbers, tokens, lengths)
                    docs, numbers, tokens, lengths = [], [], [], []
            if tokens:
                yield found(docs, numbers, tokens, lengths)

    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = spread(documents.select("doc_id", "text").filter("text is not null"))
    return rows.mapInPandas(run, f"doc_id {kind}, reading int, tab int, own bigint, said string, key bigint")


def _near(hits: DataFrame, items: DataFrame, masks: np.ndarray, cfg: LeakConfig) -> DataFrame:
    """hits with the id of the item windows within the radius. A pair that agrees in several block keys is taken from the first of them."""
    differ = F.col("own").bitwiseXOR(F.col("print"))
    first = F.array_position(F.array(*[differ.bitwiseAND(F.lit(int(m))) == 0 for m in masks.view(np.int64)]), True) - 1
    # merge joins here and below: the tables of items have no bound that would allow a broadcast
    met = hits.join(items.hint("merge"), "key").filter((F.bit_count(differ) <= cfg.radius) & (first == F.col("tab")))
    return met.select("doc_id", "reading", "said", "id")


def _verified(pairs: DataFrame, sent, cfg: LeakConfig) -> DataFrame:
    """(doc_id, reading, item_id, part, starts, similarity): window pairs that are similar; starts is null where the passage is not word for word one that counts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        similarity = Similarity(sent.value, cfg)
        for batch in batches:
            value = np.array([similarity.of(a, b) for a, b in zip(batch.said, batch.passage)])
            same = (batch.said == batch.passage).to_numpy() & (batch["size"] == cfg.window).to_numpy()
            out = batch[["doc_id", "reading", "item_id", "part"]].assign(starts=batch.starts.where(same, None), similarity=value)
            yield out[value >= cfg.threshold]

    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}
    names = ["doc_id", "reading", "said", "item_id", "part", "size", "starts", "passage"]
    return pairs.select(names).mapInPandas(run, f"doc_id {kinds['doc_id']}, reading int, item_id {kinds['item_id']}, part string, starts array<int>, similarity double")


def covered(starts: Column, window: int) -> Column:
    """Words of the item that lie in some of the windows; starts ascending."""
    zero = F.struct(F.lit(None).cast("int").alias("last"), F.lit(0).alias("n"))
    step = lambda acc, s: F.struct(s.alias("last"), (acc["n"] + F.least(F.lit(window), F.coalesce(s - acc["last"], F.lit(window)))).alias("n"))
    return F.aggregate(starts, zero, step, lambda acc: acc["n"])


def similar_passages(documents: DataFrame, items: DataFrame, cfg: LeakConfig = LeakConfig()) -> DataFrame:
    """(doc_id, item_id, windows, shared_words, similarity): every document with a window similar to one of an item.

    windows: windows of cfg.window words that stand in the document word for word (0 where the passage was
    edited), shared_words: words of the item in them, similarity: the greatest of any window.
    documents: doc_id, text; items: item_id, text; further columns are ignored. Null texts, texts shorter
    than the window and empty tables give no rows; repeated rows give one row per (doc_id, item_id). All
    items count, whatever their split; there is no cap on documents, items or matches.
    """
    context = documents.sparkSession.sparkContext
    windows = cut(_item_windows(items, cfg))
    index = _index(windows, cfg)
    hits = _document_windows(documents, context.broadcast(index), cfg)
    near = _near(hits, _keyed(windows, index), index.masks, cfg)
    pairs = near.join(windows.select("id", "item_id", "part", "size", "starts", "passage").hint("merge"), "id")
    found = _verified(pairs, context.broadcast(word_weights(items, cfg)), cfg)
    each = found.groupBy("doc_id", "reading", "item_id", "part").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("starts")))).alias("starts"), F.max("similarity").alias("similarity"))
    return each.groupBy("doc_id", "item_id").agg(F.max(F.size("starts")).alias("windows"), F.max(covered(F.col("starts"), cfg.window)).alias("shared_words"), F.round(F.max("similarity"), 6).alias("similarity"))


def leaked_passages(documents: DataFrame, items: DataFrame, cfg: LeakConfig = LeakConfig()) -> DataFrame:
    """The rows of similar_passages where at least one passage of cfg.window words stands word for word."""
    return similar_passages(documents, items, cfg).filter("windows > 0")
