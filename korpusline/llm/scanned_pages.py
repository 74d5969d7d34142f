"""Problem 5: noise in the text of scanned pages.

Method as dealt: skip-gram vectors of the words, learned by Spark's Word2Vec over all pages; links from
rare words to frequent neighbours over plausible glyph edits; each occurrence corrected where its
context is like those of the frequent word; then removal of page furniture and reflow.

The vocabulary of a large collection has no bound, so words are hashed into cfg.slots places before
the vectors are learned: the model has a fixed size and every word has a vector. Word counts, links,
contexts and repeated lines are tables joined by Spark. What is broadcast is the model and a bitmap
that tells which words are worth emitting; the bitmap never decides a result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import Word2Vec
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korpusline.functions.scan import running_last, running_sum
from korpusline.functions.session import cut, spread
from korpusline.llm import bitmaps
from korpusline.llm.words import WordHashes


@dataclass(frozen=True)
class ScanConfig:
    """letters: length of a word that is corrected, at least; frequent: occurrences of a neighbour, at least;
    ratio: how many times as frequent as the misread word (for edits between letters of one script; others
    show by themselves); similar: cosine of the contexts of both words, at least; here: cosine of the context of
    one occurrence with those of the frequent word, at least; slots, dim: places and length of the learned vectors;
    rounds: rounds of learning; edge_lines: lines at the top and the bottom where furniture stands; pages: pages of a file that repeat a line;
    files: files that repeat a line shape."""

    letters: int = 3
    frequent: int = 5
    ratio: int = 25
    similar: float = 0.25
    here: float = 0.15
    slots: int = 1 << 14
    dim: int = 32
    rounds: int = 1
    edge_lines: int = 3
    pages: int = 2
    files: int = 3
    seed: int = 5


# Pairs (right, read) of glyphs that recognition mistakes for each other.
GLYPHS = [
    ("о", "o"), ("о", "0"), ("а", "a"), ("е", "e"), ("р", "p"), ("с", "c"), ("к", "k"), ("у", "y"), ("х", "x"), ("т", "t"), ("м", "m"), ("н", "h"), ("в", "b"),
    ("т", "г"), ("и", "н"), ("л", "п"), ("д", "л"), ("п", "л"), ("й", "и"), ("щ", "ш"), ("ш", "щ"), ("ц", "u"), ("н", "и"), ("г", "т"), ("е", "с"),
    ("б", "6"), ("ч", "4"), ("з", "3"), ("м", "rn"), ("ы", "ьі"), ("ы", "ьi"), ("ы", "bi"), ("ж", ">к"), ("ж", "жк"), ("ю", "іо"), ("ю", "io"), ("ш", "ін"), ("ф", "ср"),
    ("e", "c"), ("c", "e"), ("n", "ri"), ("m", "rn"), ("h", "li"), ("i", "l"), ("l", "i"), ("l", "1"), ("i", "1"), ("o", "0"), ("b", "6"), ("s", "5"), ("d", "cl"), ("w", "vv"), ("g", "q"), ("u", "ii"), ("ü", "u"), ("ö", "o"), ("ä", "a"), ("ß", "b"),
]
MARKS = "~^■¬|\\*_`'\xad"
HOMOGLYPHS = str.maketrans("oaepckyxtmhb0364", "оаерскухтмнвозбч")

#: A run of characters that may be a word with misread characters in it.
PIECE = re.compile(r"[^\s\-‐‑–—/,;:.()«»“”„\"!?№%°+=\[\]{}<]+")
CYRILLIC = re.compile(r"[Ѐ-ӿ]")
LATIN = re.compile(r"[a-zäöüßA-ZÄÖÜ]")
INSIDE = re.compile(r"[^\W\d_][~^■¬|\\*_`>]+[^\W\d_]")
LOWER_DIGIT = re.compile(r"[^\W\d_]{2}[0-9](?=[^\W\d_]|\b)|[0-9][^\W\d_]{3}|^[^\W\d_][0-9][^\W\d_]{2}")
BROKEN = re.compile(r"([^\W\d_])[-‐‑¬\xad–—][ \t]*\r?\n[ \t]*(?=[a-zäöüßа-яёѐ-џ])")

#: A line that is a page number in a form that nothing else has: in brackets, between dashes, of so many, or after a word for a page.
PAGE_LINE = re.compile(r"^\W*(?:\[\s*\d{1,4}\s*\]|[-–—]\s*\d{1,4}\s*[-–—]|\d{1,4}\s*/\s*\d{1,4}|([^\W\d]+\.?)\s*\d{1,4}(?:\s*(?:из|of|von|/)\s*\d{1,4})?)\W*$", re.I)
# Words for a page, and their abbreviations.
PAGE_WORDS = ("страница", "лист", "page", "seite", "blatt", "sheet")
PAGE_SHORT = ("стр", "стр.", "с.", "р.")
BARE_NUMBER = re.compile(r"^\s*(\d{1,4})\s*$")
SENTENCE_END = re.compile(r"[.!?:;…][\"»”)]*\s*$")


def unfold(line: str) -> str:
    """A line with glyphs that look alike made equal, and without blanks; misread furniture stays equal to itself."""
    return re.sub(r"\s+", "", line.lower().translate(HOMOGLYPHS).replace("rn", "м").replace("п", "л").replace("д", "л").replace("г", "т").replace("н", "и").replace("й", "и").replace("щ", "ш").translate({ord(c): None for c in MARKS}))


def shape(line: str) -> str:
    """The line with numbers and short codes made alike."""
    return unfold(re.sub(r"\d+", "#", re.sub(r"\b[A-ZА-ЯЁ]{1,3}\b", "@", line)).replace("#", "9"))


UNFOLDED_WORDS = tuple(unfold(w) for w in PAGE_WORDS)


def is_page_word(word: str) -> bool:
    """A word for a page, with its look-alike glyphs made equal; in long words one more letter may be misread."""
    if word.lower() in PAGE_SHORT:
        return True
    own = unfold(word)
    return any(len(own) == len(known) and sum(a != b for a, b in zip(own, known)) <= (len(known) > 6) for known in UNFOLDED_WORDS)


def is_page_line(line: str) -> bool:
    m = PAGE_LINE.match(line)
    return bool(m) and (m[1] is None or is_page_word(m[1]))


def is_scan(metadata: str = "metadata") -> Column:
    return F.col(metadata)["ocr"].isNotNull()


def file_key() -> Column:
    """One key per file: category and doc_id, or else the path, with one kind of separator and no leading ./"""
    path = F.regexp_replace(F.regexp_replace("doc_path", r"\\", "/"), r"^\./", "")
    return F.concat_ws("::", F.coalesce("category", F.lit("")), F.coalesce("doc_id", path, F.lit("")))


def scan_pages(elements: DataFrame) -> DataFrame:
    """(id, file, page, elem_order, text) of the recognised pages, each id once."""
    return elements.filter(is_scan() & F.col("text").isNotNull()).select("id", file_key().alias("file"), "page", "elem_order", "text").dropDuplicates(["id"])


def word_counts(elements: DataFrame) -> DataFrame:
    """(word, n, scans): occurrences in all texts, and in scanned pages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        everywhere: Counter = Counter()
        scanned: Counter = Counter()

        def flush() -> pd.DataFrame:
            words = list(everywhere)
            out = pd.DataFrame({"word": words, "n": [everywhere[w] for w in words], "scans": [scanned[w] for w in words]})
            everywhere.clear()
            scanned.clear()
            return out

        for batch in batches:
            for text, scan in zip(batch.text, batch.scan):
                own = PIECE.findall(BROKEN.sub(r"\1", text).lower() if scan else text.lower())
                everywhere.update(own)
                if scan:
                    scanned.update(own)
            if len(everywhere) > 1_000_000:
                yield flush()
        if everywhere:
            yield flush()

    counted = elements.filter(F.length("text") > 0).select("text", is_scan().alias("scan")).mapInPandas(run, "word string, n bigint, scans bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n"), F.sum("scans").alias("scans"))


def plain(word: str) -> bool:
    """Whether the word shows no trace of misreading by itself: one script, no digit or mark inside."""
    return not (INSIDE.search(word) or CYRILLIC.search(word) and LATIN.search(word) or LOWER_DIGIT.search(word))


def corrections(word: str) -> set[str]:
    """Words from which one glyph edit makes this one; marks and look-alike letters may also be undone all at once."""
    out = set()
    for right, read in GLYPHS:
        at = word.find(read)
        while at >= 0:
            out.add(word[:at] + right + word[at + len(read) :])
            at = word.find(read, at + 1)
    bare = "".join(c for c in word if c not in MARKS)
    out.add(bare)
    if CYRILLIC.search(word):
        folded = bare.replace("rn", "м").replace(">к", "ж").replace("іо", "ю").replace("ьі", "ы").translate(HOMOGLYPHS)
        out.add(folded)
    out.discard(word)
    return {x for x in out if len(x) > 1}


def glyph_links(counts: DataFrame, cfg: ScanConfig) -> DataFrame:
    """(word, right, plain): rare words of scanned pages with their most frequent neighbour over a glyph edit."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for word, n in zip(batch.word, batch.n):
                if sum(c.isalpha() for c in word) >= cfg.letters:
                    shows = plain(word)
                    rows += [(word, right, n, shows) for right in corrections(word)]
            yield pd.DataFrame(rows, columns=["word", "right", "own", "plain"])

    edits = counts.filter("scans > 0").select("word", "n").mapInPandas(run, "word string, right string, own bigint, plain boolean")
    neighbours = counts.filter(F.col("n") >= cfg.frequent).select(F.col("word").alias("right"), "n")
    linked = edits.join(neighbours, "right").filter(F.col("n") >= F.when(F.col("plain"), cfg.ratio * F.col("own")).otherwise(F.col("own")))
    return linked.groupBy("word", "plain").agg(F.max_by("right", F.struct("n", "right")).alias("right"))


def words_of(text: str) -> list[str]:
    """The words of a page, with those broken at line ends joined."""
    return PIECE.findall(BROKEN.sub(r"\1", text).lower())


class Watched(dict):
    """word -> whether its bit is set; the hash is that of the SQL function xxhash64."""

    def __init__(self, packed: np.ndarray):
        super().__init__()
        self.packed = packed

    def __missing__(self, word: str) -> bool:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = bool(bitmaps.has(self.packed, np.array([spark_xxhash64(word)]))[0])
        return value


def spark_xxhash64(word: str) -> int:
    """The value of the SQL function xxhash64 for one string, as a signed number."""
    import xxhash

    value = xxhash.xxh64_intdigest(word.encode(), seed=42)
    return value - (1 << 64) if value >> 63 else value


def skip_gram(pages: DataFrame, cfg: ScanConfig) -> np.ndarray:
    """Skip-gram vectors of the hashed words, learned over all pages by Spark's Word2Vec: one row a slot, zeros for slots without a word.

    Every partition learns on its own pages and Spark averages the parts; what reaches the driver is the
    model, cfg.slots * cfg.dim numbers whatever the data.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            yield pd.DataFrame({"words": [[str(hashes[w] & (cfg.slots - 1)) for w in words_of(text)] for text in batch.text]})

    out = np.zeros((cfg.slots, cfg.dim), np.float32)
    tokens = pages.select("text").mapInPandas(run, "words array<string>").filter(F.size("words") > 0)
    if tokens.isEmpty():
        return out
    parts = max(pages.rdd.getNumPartitions(), pages.sparkSession.sparkContext.defaultParallelism)
    model = Word2Vec(vectorSize=cfg.dim, windowSize=2, minCount=1, maxIter=cfg.rounds, numPartitions=parts, seed=cfg.seed, inputCol="words", outputCol="vec").fit(tokens)
    for r in model.getVectors().collect():
        out[int(r.word)] = r.vector.toArray()
    return out


def contexts(tokens: list[str], vectors: np.ndarray, hashes: WordHashes) -> np.ndarray:
    """The context of every token: the vectors of the two words on either side, the nearer ones double. Pages are set apart by blank tokens."""
    own = vectors[(hashes.of(tokens) & np.uint64(len(vectors) - 1)).astype(np.int64)]
    own[[n for n, w in enumerate(tokens) if w == "\n"]] = 0
    around = np.zeros_like(own)
    for k, weight in ((1, 1.0), (2, 0.5)):
        around[k:] += np.float32(weight) * own[:-k]
        around[:-k] += np.float32(weight) * own[k:]
    return around


def alike(rows: DataFrame, a: str, b: str, least: float, usual: np.ndarray) -> DataFrame:
    """The rows of which the vectors a and b, less the usual context, have a cosine of at least `least`."""
    at = [rows.columns.index(a), rows.columns.index(b)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (batch.column(k).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) - usual for k in at)
                yield batch.filter(pa.array((x * y).sum(axis=1) >= least * np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))))

    return rows.mapInArrow(run, rows.schema)


@dataclass(frozen=True)
class Reader:
    """What is learned: links (word, right, vec: the context of `right`) that the contexts of both words bear out, the model, and the usual context."""

    links: DataFrame
    vectors: object
    usual: np.ndarray


def learn(elements: DataFrame, pages: DataFrame, cfg: ScanConfig) -> tuple[Reader, DataFrame]:
    """Links from all word counts, the skip-gram model from all pages, the links that stand the test of context, and the traces of the pages."""
    links = cut(glyph_links(cut(word_counts(elements)), cfg))
    vectors = pages.sparkSession.sparkContext.broadcast(skip_gram(pages, cfg))
    traces = cut(page_traces(pages, links, vectors, cfg))
    means = cut(context_means(traces, cfg))
    first = means.filter("word = ''").select("vec").first()
    usual = np.array(first.vec if first else [0.0] * cfg.dim, np.float32)
    own = links.join(means.select("word", F.col("vec").alias("own")), "word").join(means.select(F.col("word").alias("right"), "vec"), "right")
    return Reader(cut(alike(own.select("word", "right", "own", "vec"), "own", "vec", cfg.similar, usual).drop("own")), vectors, usual), traces


def page_lines(text: str) -> list[str]:
    return re.split(r"\r?\n", text)


def edge_lines(text: str, count: int) -> list[tuple[int, str, bool]]:
    """(line number, line, whether it is the outermost) of the non-blank lines at the top and the bottom."""
    lines = [(n, x) for n, x in enumerate(page_lines(text)) if x.strip()]
    top, bottom = lines[:count], lines[max(count, len(lines) - count) :]
    return [(n, x, k == 0) for k, (n, x) in enumerate(top)] + [(n, x, k == len(bottom) - 1) for k, (n, x) in enumerate(bottom)]


def page_number_lines(text: str, page: int | None) -> set[int]:
    """Lines that hold a page number: in a form of their own anywhere, as a bare number at the very top or bottom."""
    lines = page_lines(text)
    out = {n for n, x in enumerate(lines) if is_page_line(x)}
    filled = [n for n, x in enumerate(lines) if x.strip()]
    for k in {*filled[:1], *filled[-1:]}:
        if (m := BARE_NUMBER.match(lines[k])) and len(filled) > 1:
            before = lines[filled[-2]] if k == filled[-1] else ""
            if k == filled[0] or SENTENCE_END.search(before) or page is not None and abs(int(m[1]) - page) <= 1:
                out.add(k)
    return out


def edges(pages: DataFrame, cfg: ScanConfig) -> DataFrame:
    """(id, file, line, same, alike): the edge lines of all pages with their forms for comparison."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, file, text in zip(batch.id, batch.file, batch.text):
                rows += [(key, file, n, unfold(x), shape(x)) for n, x, _ in edge_lines(text, cfg.edge_lines) if not is_page_line(x) and len(x.strip()) > 3]
            yield pd.DataFrame(rows, columns=["id", "file", "line", "same", "alike"])

    return pages.select("id", "file", "text").mapInPandas(run, "id string, file string, line int, same string, alike string")


def furniture(pages: DataFrame, cfg: ScanConfig) -> DataFrame:
    """(id, line): running headers and footers, that is edge lines that several pages of a file repeat, and
    edge lines of a shape that several files use so."""
    lines = cut(edges(pages, cfg))
    repeated = lines.groupBy("file", "same").agg(F.count(F.lit(1)).alias("n"), F.min("alike").alias("alike")).filter(F.col("n") >= cfg.pages)
    shapes = repeated.groupBy("alike").agg(F.count(F.lit(1)).alias("files")).filter(F.col("files") >= cfg.files)
    own = lines.join(repeated.select("file", "same"), ["file", "same"], "left_semi").select("id", "line")
    shared = lines.join(shapes, "alike", "left_semi").select("id", "line")
    return own.unionByName(shared).distinct()


def page_traces(pages: DataFrame, links: DataFrame, vectors, cfg: ScanConfig) -> DataFrame:
    """(id, trace, at, word, around, n): traces of noise in one page, and contexts.

    A row of a linked word has its number `at` among the words of the page, and the context there. Rows without
    an id are sums of n contexts: of the words that links lead to, and of all words, under the empty word.
    """
    context = pages.sparkSession.sparkContext
    misread, right = (context.broadcast(bitmaps.of_keys(links.select(F.xxhash64(c).alias("key")))) for c in ("word", "right"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, linked, aimed = WordHashes(), Watched(misread.value), Watched(right.value)
        for batch in batches:
            rows = []
            tokens: list[str] = []
            places: list[tuple] = []
            for key, page, text in zip(batch.id, batch.page, batch.text):
                if BROKEN.search(text):
                    rows.append((key, "hyphen", None, None, None, 0))
                if page_number_lines(text, None if pd.isna(page) else int(page)):
                    rows.append((key, "page number", None, None, None, 0))
                own = PIECE.findall(BROKEN.sub(r"\1", text))
                if any(shows_itself(w, cfg) for w in set(own)):
                    rows.append((key, "misread", None, None, None, 0))
                low = [w.lower() for w in own]
                tokens += ["\n", "\n"]
                places += [(len(tokens) + n, key, n, w) for n, w in enumerate(low) if linked[w]]
                tokens += low
            tokens += ["\n", "\n"]
            around = contexts(tokens, vectors.value, hashes)
            rows += [(key, None, n, word, around[at], 1) for at, key, n, word in places]
            word = np.array([w != "\n" for w in tokens])
            rows.append((None, None, None, "", around[word].sum(axis=0), int(word.sum())))
            at = np.array([n for n, w in enumerate(tokens) if w != "\n" and aimed[w] and not linked[w]], np.int64)
            if len(at):
                number: dict[str, int] = {}
                owner = np.array([number.setdefault(tokens[n], len(number)) for n in at])
                order = np.argsort(owner, kind="stable")
                sums = np.add.reduceat(around[at][order], np.searchsorted(owner[order], np.arange(len(number))), axis=0)
                rows += [(None, None, None, w, total, n) for w, total, n in zip(number, sums, np.bincount(owner).tolist())]
            yield pd.DataFrame(rows, columns=["id", "trace", "at", "word", "around", "n"]).astype({"at": "Int32"})

    return pages.select("id", "page", "text").mapInPandas(run, "id string, trace string, at int, word string, around array<float>, n bigint")


def context_means(traces: DataFrame, cfg: ScanConfig) -> DataFrame:
    """(word, vec): the mean context of linked words, of those that links lead to, and of all words (the empty word)."""
    each = [(F.sum(F.col("around")[k].cast("double")) / F.sum("n")).cast("float") for k in range(cfg.dim)]
    return traces.filter("word is not null").groupBy("word").agg(F.array(*each).alias("vec"))


def shows_itself(word: str, cfg: ScanConfig) -> bool:
    """A word of two scripts, or with a mark between letters, is misread whatever its context."""
    return bool(INSIDE.search(word) or CYRILLIC.search(word) and LATIN.search(word)) and sum(c.isalpha() for c in word) >= cfg.letters


def corrected(traces: DataFrame, reader: Reader, cfg: ScanConfig) -> DataFrame:
    """(id, at, right): the occurrences of linked words whose own context is like that of the right word."""
    found = traces.filter("at is not null").select("id", "at", "word", "around").join(reader.links, "word").select("id", "at", "right", "around", "vec")
    return alike(found, "around", "vec", cfg.here, reader.usual).select("id", "at", "right")


SOURCE = ("id", "category", "doc_path", "doc_id", "page", "elem_order", "text", "metadata")


def noisy_pages(elements: DataFrame, cfg: ScanConfig = ScanConfig()) -> DataFrame:
    """(id, traces): scanned pages with noise, and which kinds: hyphen, misread, furniture, page number.

    elements: id, category, doc_path, doc_id, page, elem_order, text, metadata; further columns are
    ignored. Null and blank texts are no cases, nor are elements without the `ocr` entry; a repeated id
    counts once; an empty table gives no rows.
    """
    source = spread(elements.select(*SOURCE))
    pages = cut(scan_pages(source))
    reader, traces = learn(source, pages, cfg)
    sure = traces.filter("trace is not null").select("id", "trace")
    read = corrected(traces, reader, cfg).select("id", F.lit("misread").alias("trace"))
    lines = furniture(pages, cfg).select("id", F.lit("furniture").alias("trace"))
    return sure.unionByName(read).unionByName(lines).groupBy("id").agg(F.array_sort(F.collect_set("trace")).alias("traces"))


def body_of(text: str, drop: set[int], page: int | None) -> str:
    """The text of a page without furniture, page numbers and broken words."""
    gone = drop | page_number_lines(text, page)
    return BROKEN.sub(r"\1", "\n".join(x for n, x in enumerate(page_lines(text)) if n not in gone).strip("\n"))


def repair(body: str, right: dict[int, str]) -> tuple[list[str], bool]:
    """(paragraphs, whether the first continues one of the page before); right: the number of a word -> what it should be."""
    count = iter(range(len(body) + 1))

    def fix(m: re.Match) -> str:
        word, found = m[0], right.get(next(count))
        if found is None:
            return word
        return found.upper() if word.isupper() else found[0].upper() + found[1:] if word[0].isupper() or word[0].isdigit() and found[0].upper() == word[0] else found

    out = [re.sub(r"\s+", " ", p).strip() for p in re.split(r"\n\s*\n", PIECE.sub(fix, body))]
    out = [p for p in out if p]
    return out, bool(out) and out[0][0].islower()


def page_bodies(pages: DataFrame, cfg: ScanConfig) -> DataFrame:
    """(id, file, page, place, text): the pages without furniture; place orders the pages of a file, those without a number by their elem_order first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            text = [body_of(t, set(drop) if drop is not None else set(), None if pd.isna(page) else int(page)) for t, drop, page in zip(batch.text, batch["drop"], batch.page)]
            yield batch.drop(columns="drop").assign(text=text).astype({"page": "Int32"})

    place = F.when(F.col("page").isNull(), F.coalesce("elem_order", F.lit(0))).otherwise((F.col("page").cast("bigint") + 1) * PLACES + F.coalesce("elem_order", F.lit(0))).cast("bigint")
    lines = furniture(pages, cfg).groupBy("id").agg(F.collect_set("line").alias("drop"))
    full = pages.join(lines, "id", "left").select("id", "file", "page", place.alias("place"), "text", "drop")
    return full.mapInPandas(run, "id string, file string, page int, place bigint, text string")


#: Order numbers of one page, and pages of one block of the scan over a file.
PLACES, PAGE_BLOCK = 10_000_000, 4096


def repaired_paragraphs(elements: DataFrame, cfg: ScanConfig = ScanConfig()) -> DataFrame:
    """(file, paragraph, page_from, page_to, text): the pages of each file as continuous paragraphs, in page order.

    Pages without a number follow their elem_order before the numbered ones. A paragraph that a page
    ends without a full stop, or that the next begins in lower case, is joined over the page break.
    Paragraphs are numbered by a scan in two levels over one narrow row a page, so a file with a third of
    all pages is no single task. Rows as in noisy_pages; pages without text give none.
    """
    source = spread(elements.select(*SOURCE))
    pages = cut(scan_pages(source))
    reader, _ = learn(source, pages, cfg)
    bodies = cut(page_bodies(pages, cfg))
    fixes = corrected(page_traces(bodies, reader.links, reader.vectors, cfg), reader, cfg).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("at", "right"))).alias("fixes"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = [repair(text, dict(right) if right is not None else {}) for text, right in zip(batch.text, batch.fixes)]
            out = batch[["id", "file", "page", "place"]].assign(parts=[p for p, _ in done], carries=[c for _, c in done], ended=[bool(p) and bool(SENTENCE_END.search(p[-1])) for p, _ in done])
            yield out[[bool(p) for p, _ in done]].astype({"page": "Int32"})

    read = cut(bodies.join(fixes, "id", "left").mapInPandas(run, "id string, file string, page int, place bigint, parts array<string>, carries boolean, ended boolean"))
    narrow = read.select("id", "file", "place", "carries", "ended", F.size("parts").alias("size"))
    block = PLACES * PAGE_BLOCK
    after = running_last(narrow, ["file"], "place", "id", "ended", "ended_before", block, inclusive=False)
    joins = F.col("carries") | ~F.coalesce("ended_before", F.lit(True))
    numbered = running_sum(after.withColumn("begun", F.col("size") - joins.cast("int")), ["file"], "place", "id", "begun", "upto", block)
    # the number of a page's last paragraph is the sum up to it
    placed = read.join(numbered.select("id", (F.col("upto") - F.col("size")).alias("before")), "id")
    pieces = placed.select("file", "page", "place", "id", "before", F.posexplode("parts").alias("n", "text")).withColumn("paragraph", F.col("before") + F.col("n") + 1)
    listed = F.array_sort(F.collect_list(F.struct("place", "id", "n", "text")))
    return pieces.groupBy("file", "paragraph").agg(F.min("page").alias("page_from"), F.max("page").alias("page_to"), F.array_join(F.transform(listed, lambda x: x["text"]), " ").alias("text"))
