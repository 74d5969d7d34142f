"""Problem 8: texts that stop before their end.

Method as dealt: a trie of the corpus vocabulary; a text is flagged where its last token is an
unknown proper prefix of known words, together with evidence from lengths. As texts are also cut
after whole words, the corpus gives two more counts: how often a sentence or line ends after the
last tokens (`ends` of `total`), and which shapes complete lines without a full stop have.

All counts come from one pass over all documents, added up per task before the shuffle. The trie is
a table of (prefix, count) rows, so that looking up a last token is a join and nothing is collected.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korpusline.functions.session import cut, spread
from korpusline.llm.words import CACHE_ENTRIES


@dataclass(frozen=True)
class CutConfig:
    """known: occurrences that make a word known; least: weight of the prior in a share, in occurrences;
    inside: share of ends after the last tokens under which the text ends inside a sentence;
    open_end: the same share where the length is a limit of its source; limit_docs: different texts
    of equal length that make a length a limit, where they are limit_ratio times what lengths up to
    limit_near away have, and chance gives so many once in exp(limit_odds) lengths; limit_tight: the
    nearest lengths, for which limit_ratio holds too; line_tokens: tokens of a line shape, at most (longer
    lines are no headings or signatures); keys: counts a task holds before it hands them on;
    broadcast_limits: rows of limits up to which they are broadcast."""

    known: int = 2
    least: int = 4
    inside: float = 0.12
    open_end: float = 0.8
    limit_docs: int = 3
    limit_ratio: float = 16.0
    limit_odds: float = 14.0
    limit_near: int = 64
    limit_tight: int = 8
    line_tokens: int = 14
    keys: int = 1_500_000
    broadcast_limits: int = 100_000


#: A full stop that ends a sentence: before a line end, the end of the text, or a capital letter or digit.
STOP = re.compile(r"(?<![.!?…])[.!?…]+[\"»”’)\]]*(?=\s*\n|\s*\Z|\s+[\"«“(•\-–—]*\s*[A-ZÄÖÜА-ЯЁЂ-Џ\d])")
TOKEN = re.compile(r"[^\W_]+|[^\w\s]|\n|_+")
#: What a cut may leave behind, and what does not count at an end.
BLANKS = "".join(c for c in map(chr, range(0x10000)) if re.match(r"\s", c)) + "​‌‍⁠﻿"
DOTS = ".…�"
REMAINS = re.compile(r"(?:\.{2,}|…|�)[\s.…�]*\Z")
ENDED = re.compile(r"[.!?][\"»”’)\]]*\Z")
LAST_WORD = re.compile(r"(?<![^\W\d_])[^\W\d_]+\Z")


def masked(token: str) -> str:
    """The token's class in a context: numbers are alike, capitalised words are alike, the rest stands for itself."""
    if token[0].isdigit() or any(c.isdigit() for c in token):
        return "0"
    if token[0].isupper():
        return "AA" if len(token) > 1 and token.isupper() else "Aa"
    return token


class Masks(dict):
    def __missing__(self, token: str) -> str:
        if len(self) > CACHE_ENTRIES:
            self.clear()
        value = self[token] = masked(token)
        return value


#: Stands for the end of a sentence; a line end stands for itself.
FULL = "\x02"
ENDS = ("\n", FULL)


def tokens_of(text: str, masks: Masks) -> tuple[list[str], list[str]]:
    """(tokens, masks), with sentence ends and line ends as tokens; a word after one is kept in lower case."""
    tokens = TOKEN.findall(STOP.sub(FULL, text))
    classes = [masks[x] for x in tokens]
    for end in ENDS:
        at = -1
        for _ in range(tokens.count(end)):
            at = tokens.index(end, at + 1)
            if at + 1 < len(tokens) and classes[at + 1] in ("Aa", "AA"):
                classes[at + 1] = tokens[at + 1].lower()
    if tokens and classes[0] in ("Aa", "AA"):
        classes[0] = tokens[0].lower()
    return tokens, classes


def line_shape(classes: list[str]) -> str:
    """The first token as it is, then the kinds of the others; runs of one kind count once."""
    kinds = [x if not x[0].isalpha() or x in ("Aa", "AA") else "a" for x in classes[1:]]
    return " ".join([classes[0], *(k for n, k in enumerate(kinds) if n == 0 or k != kinds[n - 1])])


def stripped(text: str) -> tuple[str, bool]:
    """(the text without blanks and remains of a cut at its end, whether there were remains)."""
    body = text.rstrip(BLANKS)
    tail = len(body.rstrip(BLANKS + DOTS))
    found = REMAINS.search(body, tail)
    bare = body[: found.start()].rstrip(BLANKS) if found else body
    return bare, bare != body


def corpus_counts(documents: DataFrame, cfg: CutConfig) -> DataFrame:
    """(key, total, ends, dots), added up over all documents.

    Keys: `2` two last tokens, `1` last token: how often they occur, how often a sentence or line ends
    there, how often a full stop follows that ends nothing. `w` a word, `s` the shape of a complete line.
    What stands at the very end of a text is not counted: its last token, without what a cut may have left behind.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        masks = Masks()
        words: Counter = Counter()
        triples: Counter = Counter()
        shapes: Counter = Counter()

        def flush() -> pd.DataFrame:
            total: Counter = Counter()
            ends: Counter = Counter()
            dots: Counter = Counter()
            for (a, b, c), n in triples.items():
                if b in ENDS:
                    continue
                for key in (f"2{a} {b}".replace(FULL, "\n"), f"1{b}"):
                    total[key] += n
                    if c in ENDS:
                        ends[key] += n
                    elif c == ".":
                        dots[key] += n
            for word, n in words.items():
                if word[0].isalpha():
                    total["w" + word.lower()] += n
            for shape, n in shapes.items():
                total["s" + shape] += n
            for x in (words, triples, shapes):
                x.clear()
            keys = list(total)
            return pd.DataFrame({"key": keys, "total": [total[k] for k in keys], "ends": [ends[k] for k in keys], "dots": [dots[k] for k in keys]})

        for batch in batches:
            for text in batch.text:
                tokens, classes = tokens_of(stripped(text)[0], masks)
                words.update(tokens[:-1])
                triples.update(zip(["\n", *classes], classes, classes[1:]))
                start = 0
                for _ in range(tokens.count("\n")):
                    end = tokens.index("\n", start)
                    if 0 < end - start <= cfg.line_tokens and FULL not in tokens[start:end]:
                        shapes[line_shape(classes[start:end])] += 1
                    start = end + 1
            if len(words) + len(triples) > cfg.keys:
                yield flush()
        if words or triples or shapes:
            yield flush()

    counted = documents.filter("length(text) > 0").select("text").mapInPandas(run, "key string, total bigint, ends bigint, dots bigint")
    return counted.groupBy("key").agg(F.sum("total").alias("total"), F.sum("ends").alias("ends"), F.sum("dots").alias("dots"))


def trie(counts: DataFrame, cfg: CutConfig) -> DataFrame:
    """(key, total): for every proper prefix of a known word, how often words with this prefix occur."""
    word = F.expr("substring(key, 2)")
    known = counts.filter(F.startswith("key", F.lit("w")) & (F.col("total") >= cfg.known) & (F.length("key") > 2)).select(word.alias("word"), "total")
    prefixes = known.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda n: F.substring("word", F.lit(1), n))).alias("prefix"), "total")
    return prefixes.groupBy(F.concat(F.lit("p"), "prefix").alias("key")).agg(F.sum("total").alias("total"))


def text_ends(documents: DataFrame, cfg: CutConfig) -> DataFrame:
    """One row per text that may have been cut: what to look up about its end. The whole last line is read."""
    kind = documents.select("doc_id").schema[0].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        masks = Masks()
        for batch in batches:
            rows = []
            for doc, text in zip(batch.doc_id, batch.text):
                bare, remains = stripped(text)
                if not bare:
                    if remains:
                        rows.append((doc, "broken", None, None, None, None, None))
                    continue
                broken = "�" in text[len(bare) :]
                dotted = bool(ENDED.search(bare)) and not remains
                line = bare[bare.rfind("\n") + 1 :]
                end = (ENDED.sub("", line) if dotted else line).rstrip()
                tokens, classes = tokens_of(end, masks)
                if not tokens or tokens[-1] in ENDS:
                    continue
                full = max((n for n, x in enumerate(tokens) if x == FULL), default=-1)
                own = classes[full + 1 :]
                last = LAST_WORD.search(end)
                rows.append(
                    (
                        doc,
                        "broken" if broken else "dotted" if dotted else "open",
                        "2" + " ".join((["\n", *classes])[-2:]).replace(FULL, "\n"),
                        "1" + classes[-1],
                        "w" + last[0].lower() if last else None,
                        "p" + last[0].lower() if last else None,
                        "s" + line_shape(own) if full < 0 and len(own) <= cfg.line_tokens else None,
                    )
                )
            yield pd.DataFrame(rows, columns=["doc_id", "state", "two", "one", "word", "prefix", "shape"])

    return documents.filter("length(text) > 0").select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, state string, two string, one string, word string, prefix string, shape string")


#: Bytes of a character that a byte limit may cut off, or that stand for it as a replacement character.
PART = 3


def limits(documents: DataFrame, cfg: CutConfig) -> DataFrame:
    """(of, unit, size, short): lengths of a source, in characters or bytes, whose count stands out from their neighbours'.

    The share of the source does not matter. Copies of a text count once. A byte limit leaves texts up to
    three bytes shorter, where it would split a character: they count with it, and their lengths are listed
    with the bytes they are short. Bytes are counted for texts where they differ from the characters.
    """
    texts = documents.filter("length(text) > 0").select("source", F.xxhash64("text").alias("hash"), F.length("text").alias("chars"), F.octet_length("text").alias("bytes")).distinct()
    sizes = texts.select("source", F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("size")), F.when(F.col("bytes") > F.col("chars"), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("size"))))).alias("x"))
    counted = sizes.filter("x is not null").groupBy("source", "x.unit", "x.size").count()
    order = Window.partitionBy("source", "unit").orderBy("size")
    in_bytes = F.col("unit") == "bytes"

    def within(below: int, above: int) -> Column:
        return F.sum("count").over(order.rangeBetween(-below, above))

    def density(reach: int, rest: int) -> Column:
        # texts a length, from lengths up to reach away; those around a byte limit have the texts it cut
        def part(own: int) -> Column:
            width = reach + F.least(F.lit(reach), F.col("size") - 1) - own - F.least(F.lit(own), F.col("size") - 1)
            return (within(reach, reach) - within(own, own) + rest) / width

        return F.when(in_bytes, part(PART)).otherwise(part(0))

    def stands_out(found: Column, lengths: int) -> Column:
        near, tight = F.col("near") * lengths, F.col("tight") * lengths
        odds = found * F.log(found / near) - (found - near)
        return (found >= cfg.limit_docs) & (found >= cfg.limit_ratio * F.greatest(near, tight)) & (odds >= cfg.limit_odds)

    above = F.coalesce(F.max("count").over(order.rangeBetween(1, PART)), F.lit(0))
    measured = counted.select("source", "unit", "size", "count", above.alias("above"), within(PART, 0).alias("pooled"), density(cfg.limit_near, 1).alias("near"), density(cfg.limit_tight + PART, 0).alias("tight"))
    # a length of a limit has its part of the pooled texts: one that merely follows the limit has not
    own = F.col("count") * 2 * (PART + 1) >= F.col("pooled")
    found = measured.filter(stands_out(F.col("count"), 1) | in_bytes & own & stands_out(F.col("pooled"), PART + 1))
    # a length that is itself short of a greater count has none below it
    reach = F.when(in_bytes & (F.col("above") < F.col("count")), PART).otherwise(0)
    shorter = found.select(F.col("source").alias("of"), "unit", "size", F.explode(F.sequence(F.lit(0), reach)).alias("short"))
    return shorter.groupBy("of", "unit", (F.col("size") - F.col("short")).alias("size")).agg(F.min("short").alias("short"))


def smoothed(evidence: str, prior: Column, cfg: CutConfig) -> Column:
    """Share of ends after the evidence, with the prior as cfg.least occurrences."""
    total, ends = (F.coalesce(F.col(f"{evidence}.{part}"), F.lit(0)) for part in ("total", "ends"))
    return (ends + cfg.least * prior) / (total + cfg.least)


def truncated_texts(documents: DataFrame, cfg: CutConfig = CutConfig()) -> DataFrame:
    """(doc_id, reason) of the texts that were cut off.

    documents: doc_id, text, source; further columns are ignored. Null, empty and blank texts are no
    cases; a repeated doc_id is one row; an empty table gives none. reason: `broken` character left
    behind, `word` cut (the trie), `sentence` cut, or `limit` (open end at a limit of the source).
    """
    source = spread(documents.select("doc_id", "text", "source"))
    counts = cut(corpus_counts(source, cfg))  # read for the shares and for the trie
    known = counts.unionByName(trie(counts, cfg), allowMissingColumns=True).select("key", F.struct("total", "ends", "dots").alias("seen"))
    ends = text_ends(source, cfg)
    asked = ends.select("doc_id", "state", F.explode(F.array_compact(F.array("two", "one", "word", "prefix", "shape"))).alias("key"))
    found = asked.join(known, "key", "left").groupBy("doc_id", "state").agg(*[F.max(F.when(F.startswith("key", F.lit(k)), F.col("seen"))).alias(n) for k, n in (("2", "two"), ("1", "one"), ("w", "word"), ("p", "prefix"), ("s", "shape"))], F.max(F.startswith("key", F.lit("w"))).alias("lettered"), F.max(F.col("key").rlike(r"^1[\p{Ll}]")).alias("lower"))
    limit = cut(limits(source, cfg))
    if limit.limit(cfg.broadcast_limits + 1).count() <= cfg.broadcast_limits:
        limit = F.broadcast(limit)
    # only a character of four bytes leaves three
    widest = F.when(F.col("text").rlike(r"[\x{10000}-\x{10FFFF}]"), PART).otherwise(PART - 1)
    sized = source.select("doc_id", "source", F.length("text").alias("chars"), F.octet_length("text").alias("bytes"), widest.alias("widest"))
    at_limit = (
        sized.join(limit, F.expr("source <=> of and size = if(unit = 'chars', chars, bytes) and short <= widest"), "left_semi")
        .select("doc_id", F.lit(True).alias("limited"))
        .distinct()
    )
    rows = found.join(at_limit, "doc_id", "left").withColumn("limited", F.coalesce("limited", F.lit(False)))
    # shares of few occurrences lean on those of the shorter context, and at last on what is usual for words, names and numbers
    usual = F.when(F.col("lower"), 0.08).otherwise(0.4)
    shorter = smoothed("one", usual, cfg)
    ending = smoothed("two", shorter, cfg)
    abbreviated = F.when(F.col("one.dots") + F.col("one.ends") >= cfg.least, F.col("one.dots") / (F.col("one.dots") + F.col("one.ends"))).otherwise(0.0)
    prefix = F.col("lettered") & (F.coalesce("word.total", F.lit(0)) < cfg.known) & (F.coalesce("prefix.total", F.lit(0)) >= cfg.known)
    line = F.coalesce("shape.total", F.lit(0)) >= cfg.known
    is_open = F.col("state") == "open"
    reason = (
        F.when(F.col("state") == "broken", "broken")
        .when(is_open & prefix, "word")
        .when(is_open & ~line & (ending < cfg.inside), "sentence")
        .when(is_open & F.col("limited") & (ending < cfg.open_end), "limit")
        .when((F.col("state") == "dotted") & ((abbreviated > 0.9) | (F.col("limited") & (abbreviated > 0.4))), "sentence")
    )
    return rows.withColumn("reason", reason).filter("reason is not null").select("doc_id", "reason").dropDuplicates(["doc_id"])


def truncation_by_source(documents: DataFrame, cfg: CutConfig = CutConfig()) -> DataFrame:
    """(source, docs, cut_docs, share): how often each source truncates; texts that are null count as documents."""
    cut_docs = truncated_texts(documents, cfg).select("doc_id", F.lit(1).alias("cut"))
    rows = documents.select("doc_id", "source").distinct().join(cut_docs, "doc_id", "left")
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.count("cut").alias("cut_docs")).withColumn("share", F.round(F.col("cut_docs") / F.col("docs"), 6))
