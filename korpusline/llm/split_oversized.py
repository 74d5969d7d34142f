"""Problem 1: texts over a token limit become consecutive pieces under it.

Method as dealt: a hierarchy of separators (section, paragraph, row, sentence, word, character);
parts are packed greedily up to the limit, less the overlap that the piece really has, and each piece
but the first starts with the last sentence of the piece before it. What is left of a divided part is
packed with the parts that follow.

The whole job is a filter, a narrow projection and one Arrow-batched map: no shuffle at all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SplitConfig:
    """max_tokens: limit of a piece; chars_per_token: code points of a token;
    overlap_share: an overlap is at most this share of the limit (a longer sentence gives its last words)."""

    max_tokens: int = 512
    chars_per_token: int = 4
    overlap_share: float = 0.25

    @property
    def max_chars(self) -> int:
        return (self.max_tokens + 1) * self.chars_per_token - 1


#: Ends of parts, from the most to the least natural boundary.
SECTION = re.compile(r"\n(?=[ \t]*(?:#{1,6}\s|\d{1,3}(?:\.\d{1,3}){0,3}[.)]?[ \t]+[^\W\d_]|(?:раздел|глава|приложение|section|chapter)\s+\d))", re.I)
PARAGRAPH = re.compile(r"\n[ \t\r ]*\n\s*")
ROW = re.compile(r"\r?\n")
STOPS = ".!?…"
SENTENCE = re.compile(r"(?<![.!?…])[.!?…]+[\"»”')\]]*\s+|;\s+")
WORD_END = re.compile(r"\s+")
LEVELS = (SECTION, PARAGRAPH, ROW, SENTENCE, WORD_END)
LEVEL_NAMES = ("section", "paragraph", "row", "sentence", "word", "character")

PIECES = "item_kind string, item_id string, piece_no int, pieces int, piece_text string, token_len int, overlap_chars int, cut_at string, headings_path array<string>"


def token_len(text: Column, cfg: SplitConfig = SplitConfig()) -> Column:
    """max(1, floor(code points / 4)); null for a null text."""
    return F.when(text.isNotNull(), F.greatest(F.lit(1), F.floor(F.length(text) / cfg.chars_per_token))).cast("int")


def parts_of(text: str, lo: int, hi: int, level: int) -> list[tuple[int, int, int]]:
    """(start, end, level of the boundary at the end) of the parts that a separator divides text[lo:hi] into; the last boundary is not the separator's."""
    edges = [lo, *(m.end() for m in LEVELS[level].finditer(text, lo, hi) if lo < m.end() < hi), hi]
    return [(a, b, level) for a, b in zip(edges, edges[1:])]


def overlap_of(text: str, lo: int, hi: int, most: int) -> str:
    """What a piece repeats of text[lo:hi]: its last sentence, or the last words of a longer one, with the blanks after it as far as there is room."""
    body = text[lo:hi].rstrip()
    floor = max(0, len(body) - most + 1)
    run = len(body[:floor].rstrip(STOPS))  # a run of stops across the floor is read from its start
    starts = [m.end() for level in (ROW, SENTENCE) for m in level.finditer(body, run) if m.end() < len(body)]
    if starts:
        start = max(starts)
    elif floor:
        m = WORD_END.search(body, floor)
        start = m.end() if m else floor
    else:
        start = 0
    return body[start:] + text[lo + len(body) : hi][: most - len(body) + start] if body else ""


def pieces(text: str, cfg: SplitConfig = SplitConfig()) -> list[tuple[str, int, str]]:
    """(piece, characters repeated from the piece before, boundary it ends at); pieces without the repeats concatenate to the text."""
    limit = cfg.max_chars
    most = int(limit * cfg.overlap_share)
    out: list[tuple[str, int, str]] = []
    lead, start, at, boundary = "", 0, 0, 0
    todo = [(0, len(text), 0, 0)]
    while todo:
        lo, hi, level, end = todo.pop()
        if hi - lo <= limit - len(lead) - (at - start):
            at, boundary = hi, end
            continue
        after = overlap_of(text, start, at, most) if at > start else ""
        if at > start and (hi - lo <= limit - len(after) or level == len(LEVELS)):
            # the part fits the next piece, or is a word too long for any
            out.append((lead + text[start:at], len(lead), LEVEL_NAMES[boundary]))
            lead, start = after, at
            todo.append((lo, hi, level, end))
        elif level < len(LEVELS):
            own = parts_of(text, lo, hi, level)
            todo += [(a, b, level + 1, end if b == hi else at_end) for a, b, at_end in reversed(own)]
        else:
            equal = -(-(hi - lo) // -(-(hi - lo) // (limit - len(lead))))
            at, boundary = lo + equal, level
            todo.append((at, hi, level, end))
    if at > start:
        out.append((lead + text[start:at], len(lead), "end"))
    return out


def split_oversized(items: DataFrame, cfg: SplitConfig = SplitConfig()) -> DataFrame:
    """Pieces of every text over the limit.

    items: item_kind, item_id, text, headings_path (further columns are ignored). The stored token
    length does not count. Null, empty and short texts give no rows; a repeated row gives repeated
    pieces; a text of any length is cut whole.
    """
    narrow = items.select("item_kind", "item_id", "text", "headings_path").filter(F.length("text") > cfg.max_chars)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for kind, key, text, path in zip(batch.item_kind, batch.item_id, batch.text, batch.headings_path):
                cutted = pieces(text, cfg)
                rows += [(kind, key, n, len(cutted), piece, max(1, len(piece) // cfg.chars_per_token), repeat, at, path) for n, (piece, repeat, at) in enumerate(cutted)]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in PIECES.split(", ")])

    return narrow.mapInPandas(run, PIECES)


def text_items(elements: DataFrame, chunks: DataFrame) -> DataFrame:
    """Elements and chunks as one table of items."""
    return chunks.select(F.lit("chunk").alias("item_kind"), F.col("id").alias("item_id"), "text", F.col("heading_path").alias("headings_path")).unionByName(
        elements.select(F.lit("element").alias("item_kind"), F.col("id").alias("item_id"), "text", "headings_path")
    )


def oversized(items: DataFrame, cfg: SplitConfig = SplitConfig()) -> DataFrame:
    """The distinct items that had to be cut."""
    return split_oversized(items, cfg).filter("piece_no = 0 and pieces > 1").select("item_kind", "item_id").distinct()
