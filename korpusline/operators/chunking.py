"""Elements to chunks: running heading paths, sentence rows, greedy token budgets, overlap, merging.

What depends on the row before is told apart from what is large. Where a buffer of pieces ends, and which
small chunk joins the one before, follows from sizes alone: passes in order over narrow rows with a
state of one number. Texts are handled by buffer, and a buffer holds little more than its token budget, so a
document with a third of all rows is spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korpusline.config import ChunkConfig
from korpusline.functions import text as tx
from korpusline.functions import vectors as vc
from korpusline.functions.scan import in_order, running_last, running_sum
from korpusline.functions.session import cut
from korpusline.operators.fields import keyed


def category_path(category: str = "category") -> Column:
    """The parts of the category, the beginning of every heading path."""
    return F.filter(F.split(F.coalesce(F.regexp_replace(category, r"\\", "/"), F.lit("")), "/"), lambda x: x != "")


def heading_paths(elements: DataFrame) -> DataFrame:
    """Adds `path` (category parts and running headings) and `heads` (whether the row is a heading).

    A heading cuts the path to the category parts and its own depth, and is appended. A heading of
    depth 0 starts afresh, so the headings from one such heading to the next are a run; runs are spread
    over the tasks, and a run is passed through with no more than the present path in memory.
    """
    rows = keyed(elements).withColumn("place", F.coalesce("page", F.lit(0)).cast("bigint") * 1_000_000 + F.coalesce("elem_order", F.lit(0)))
    rows = rows.withColumn("heads", F.col("element_type").isin("paragraph", "title") & tx.is_heading("text"))
    heads = rows.filter("heads").select("doc_key", "id", "place", tx.heading_depth("text").alias("depth"), F.trim("text").alias("heading"))
    fresh = heads.withColumn("fresh", F.when(F.col("depth") == 0, 1).otherwise(0))
    runs = running_sum(fresh, ["doc_key"], "place", "id", "fresh", "run").select("doc_key", "run", "place", "id", "depth", "heading")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, stack = None, []
        for batch in batches:
            out = []
            for key, run, depth, heading in zip(batch.doc_key, batch.run, batch.depth, batch.heading):
                stack = [*(stack[:depth] if at == (key, run) else ()), heading]
                at = (key, run)
                out.append(stack)
            yield pd.DataFrame({"id": batch.id, "stack": out})

    stacks = in_order(runs, ["doc_key", "run"], ["place", "id"]).mapInPandas(fold, "id string, stack array<string>")
    empty = F.array().cast("array<string>")
    marked = rows.join(stacks, "id", "left")
    carried = running_last(marked, ["doc_key"], "place", "id", "stack", "running")
    return carried.withColumn("path", F.concat(category_path(), F.coalesce("running", empty))).drop("stack", "running")


def piece_text() -> Column:
    """Text, or else HTML, trimmed; null for blank pieces. Tables carry their heading path in a first line."""
    body = F.coalesce(tx.filled(F.trim("text")), tx.filled(F.trim("html")))
    return F.when((F.col("element_type") == "table") & (F.size("path") > 0), F.concat(F.array_join("path", " > "), F.lit("\n"), body)).otherwise(body)


def adjacent_cuts(sentences: DataFrame) -> DataFrame:
    """Adds `similarity` to the sentence before and `cut`: whether it is at or below the lower quartile of its buffer.

    sentences: buffer, pos, sentence. Buffers of fewer than three sentences have no cuts.
    """
    w = Window.partitionBy("buffer").orderBy("pos")
    whole = Window.partitionBy("buffer")
    vec = sentences.withColumn("vec", vc.encode("sentence")).withColumn("similarity", vc.dot(F.col("vec"), F.lag("vec").over(w)))
    low = F.percentile("similarity", F.lit(0.25)).over(whole)
    return vec.withColumn("cut", (F.count(F.lit(1)).over(whole) > 2) & (F.col("similarity") <= low)).drop("vec")


def pack(tokens: list[int], cuts: list[bool], most: int) -> list[tuple[int, int]]:
    """Greedy segments [from, to): a new one at a cut or where the next sentence exceeds the budget; never empty."""
    out, start, total = [], 0, 0
    for n, size in enumerate(tokens):
        if n > start and (cuts[n] or total + size > most):
            out.append((start, n))
            start, total = n, 0
        total += size
    return out + [(start, len(tokens))] if tokens else out


def _size(text: str) -> int:
    return max(1, len(text) // 4)


ROWS = "doc_key string, place bigint, id string, buffer int"
ITEMS = (
    "doc_key string, buffer int, n int, category string, doc_id string, doc_path string, text string, path array<string>, from_order int, to_order int, "
    "page_from int, page_to int, types array<string>, media array<string>, chars int"
)


def buffers(rows: DataFrame, cfg: ChunkConfig = ChunkConfig()) -> DataFrame:
    """(doc_key, place, id, buffer): the buffer of every row that is not a heading.

    A heading ends a buffer, a table is one of its own, and a piece that would bring a buffer over the
    target begins the next. rows: doc_key, place, id, heads, is_table, tokens (0 without a piece).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, number, size = None, 0, 0
        for batch in batches:
            out = []
            for own, heads, table, tokens in zip(batch.doc_key, batch.heads, batch.is_table, batch.tokens):
                if own != key:
                    key, number, size = own, 0, 0
                if heads or table and tokens:
                    number, size = number + 1, 0
                elif tokens and size and size + tokens > cfg.target_tokens:
                    number, size = number + 1, 0
                out.append(-1 if heads else number)
                if table and tokens:
                    number, size = number + 1, 0
                elif not heads:
                    size += tokens
            yield pd.DataFrame({"doc_key": batch.doc_key, "place": batch.place, "id": batch.id, "buffer": out})

    narrow = rows.select("doc_key", "place", "id", "heads", "is_table", "tokens")
    return in_order(narrow, ["doc_key"], ["place", "id"]).mapInPandas(run, ROWS).filter("buffer >= 0")


def _items_of(rows: list, cfg: ChunkConfig) -> list[tuple]:
    """The chunks of one buffer, before small ones are merged."""
    first = rows[0]
    sentences = [(s, n) for n, r in enumerate(rows) for s in (r.sentences if r.sentences is not None else ())]
    cuts = [False] * len(sentences)
    if len(sentences) > 2:
        v = vc.encode_batch([s for s, _ in sentences])
        similar = (v[1:] * v[:-1]).sum(axis=1)
        cuts = [False, *(similar <= np.quantile(similar, 0.25))]
    media = list(dict.fromkeys(r.media_path for r in rows if r.element_type in ("image", "formula") and r.media_path))
    out, before = [], []
    for n, (a, b) in enumerate(pack([_size(s) for s, _ in sentences], cuts, cfg.max_tokens)):
        own = [s for s, _ in sentences[a:b]]
        lead = before[-cfg.overlap_sentences :] if cfg.overlap_sentences else []
        while lead and _size("\n".join(lead + own)) > cfg.max_tokens:
            lead = lead[1:]
        before = own
        parts = [rows[k] for k in dict.fromkeys(k for _, k in sentences[a:b])]
        text = "\n".join(lead + own)
        pages, orders = ([int(x) for x in column if not pd.isna(x)] for column in ([r.page for r in parts], [r.elem_order for r in parts]))
        out.append(
            (first.doc_key, first.buffer, n, first.category, first.doc_id, first.doc_path, text, list(first.path), min(orders, default=0), max(orders, default=0), min(pages, default=None), max(pages, default=None), list(dict.fromkeys(r.element_type for r in parts)), media, len(text))
        )
    return out


#: Characters of texts and heading paths that are handed on at once: a long heading comes again with every chunk below it.
FRAME_CHARS = 1 << 24


def _frames(items: list[tuple], names: list[str]) -> Iterator[pd.DataFrame]:
    start, chars, text, path = 0, 0, names.index("text"), names.index("path")
    for n, item in enumerate(items):
        chars += len(item[text]) + sum(len(h or "") for h in item[path])
        if chars > FRAME_CHARS or n == len(items) - 1:
            yield pd.DataFrame(items[start : n + 1], columns=names).astype({"page_from": "Int32", "page_to": "Int32"})
            start, chars = n + 1, 0


def buffer_items(rows: DataFrame, cfg: ChunkConfig = ChunkConfig()) -> DataFrame:
    """The chunks of every buffer; rows: those of `buffers` with their sentences."""
    names = [x.split()[0] for x in ITEMS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []
        for batch in batches:
            out: list[tuple] = []
            for r in batch.itertuples():
                if held and (held[0].doc_key, held[0].buffer) != (r.doc_key, r.buffer):
                    out += _items_of(held, cfg)
                    held = []
                held.append(r)
            yield from _frames(out, names)
        yield from _frames(_items_of(held, cfg) if held else [], names)

    return in_order(rows, ["doc_key", "buffer"], ["place", "id"]).mapInPandas(run, ITEMS)


def chunk_numbers(items: DataFrame, cfg: ChunkConfig = ChunkConfig()) -> DataFrame:
    """(doc_key, buffer, n, chunk_index): a chunk under the least size joins the one before, if both fit a chunk."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, number, chars = None, -1, 0
        for batch in batches:
            out = []
            for own, size in zip(batch.doc_key, batch.chars):
                if own == key and max(1, size // 4) < cfg.min_tokens and max(1, (chars + 1 + size) // 4) <= cfg.max_tokens:
                    chars += 1 + size
                else:
                    number, chars = number + 1 if own == key else 0, size
                key = own
                out.append(number)
            yield pd.DataFrame({"doc_key": batch.doc_key, "buffer": batch.buffer, "n": batch.n, "chunk_index": out})

    return in_order(items.select("doc_key", "buffer", "n", "chars"), ["doc_key"], ["buffer", "n"]).mapInPandas(run, "doc_key string, buffer int, n int, chunk_index int")


def build_chunks(elements: DataFrame, cfg: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Chunks of all documents.

    elements: as in the schema; repeated ids count once. Blank pieces and headings give no text; a
    document without text gives no chunks. Rows go by page, elem_order and id; a missing number counts as 0.
    """
    pathed = heading_paths(elements).withColumn("piece", piece_text())
    rows = pathed.select(
        "doc_key", "place", "id", "category", "doc_id", "doc_path", "page", "elem_order", "element_type", "media_path", "path", "heads", (F.col("element_type") == "table").alias("is_table"),
        F.when(F.coalesce("piece", F.lit("")) != "", tx.token_count("piece")).otherwise(0).alias("tokens"), F.when(~F.col("heads"), tx.sentences("piece")).alias("sentences"),
    )
    rows = cut(rows.withColumn("is_table", F.coalesce("is_table", F.lit(False))))
    items = cut(buffer_items(rows.join(buffers(rows, cfg), ["doc_key", "place", "id"]), cfg))
    merged = items.join(chunk_numbers(items, cfg), ["doc_key", "buffer", "n"])
    part = F.struct("buffer", "n", "text", "types", "media")
    whole = merged.groupBy("doc_key", "chunk_index").agg(
        F.min_by(F.struct("category", "doc_id", "doc_path", F.col("path").alias("heading_path")), F.struct("buffer", "n")).alias("f"), F.array_sort(F.collect_list(part)).alias("parts"),
        F.min("from_order").alias("from_order"), F.max("to_order").alias("to_order"), F.min("page_from").alias("page_from"), F.max("page_to").alias("page_to"),
    )
    joined = whole.withColumn("text", F.array_join(F.transform("parts", lambda x: x["text"]), "\n"))
    return joined.select(
        F.md5(F.concat_ws("\u0001", "doc_key", "chunk_index")).alias("id"), "f.category", "f.doc_id", "f.doc_path", "doc_key", "text", tx.token_count("text").alias("token_len"), F.length("text").alias("char_len"),
        "chunk_index", "from_order", "to_order", "page_from", "page_to", "f.heading_path", F.array_distinct(F.flatten(F.transform("parts", lambda x: x["types"]))).alias("element_types"),
        F.array_distinct(F.flatten(F.transform("parts", lambda x: x["media"]))).alias("media_refs"),
    )


def segments(sentences: DataFrame, budget: int) -> DataFrame:
    """(buffer, pos, segment): greedy segments of sentences within a token budget, in one pass in order.

    sentences: buffer, pos, tokens. The state is one sum, so a buffer of any length is no group in memory.
    """
    kind = sentences.schema["buffer"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, total, number = None, 0, 0
        for batch in batches:
            out = []
            for own, tokens in zip(batch.buffer, batch.tokens):
                if own != key:
                    key, total, number = own, 0, 0
                elif total + tokens > budget:
                    total, number = 0, number + 1
                total += tokens
                out.append(number)
            yield pd.DataFrame({"buffer": batch.buffer, "pos": batch.pos, "segment": out})

    return in_order(sentences.select("buffer", "pos", "tokens"), ["buffer"], ["pos"]).mapInPandas(run, f"buffer {kind}, pos int, segment int")


def sentence_rows(rows: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(buffer, pos, sentence, tokens) of a text column."""
    return rows.select(F.col(key).alias("buffer"), F.posexplode(tx.sentences(text)).alias("pos", "sentence")).withColumn("tokens", tx.token_count("sentence"))

