"""File scans: listing and routing, text, CSV, JSON lines; PDF block order; optional parsers by plug-in."""

from __future__ import annotations

import csv
import io
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from korpusline import schema
from korpusline.functions import text as tx
from korpusline.sources import charset, markup, office

# Extensions that are read.
SUPPORTED = ("pdf", "docx", "doc", "pptx", "xlsx", "xls", "csv", "txt", "html", "htm", "md")
DELIMITERS = (";", ",", "|", "\t")

#: Parsers of formats that need software that is not part of this engine: extension -> function(files) -> elements.
PLUGINS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def extension(path: str | Column) -> Column:
    return F.lower(F.regexp_extract(tx.col(path), r"\.([^./\\]+)$", 1))


def is_read(path: str | Column) -> Column:
    """Whether a path is read: a known extension, no hidden or lock file, no notebook checkpoint."""
    p = F.regexp_replace(tx.col(path), r"\\", "/")
    name = F.element_at(F.split(p, "/"), -1)
    return extension(path).isin(*SUPPORTED) & ~F.contains(p, F.lit(".ipynb_checkpoints")) & ~F.startswith(name, F.lit("~$")) & ~F.startswith(name, F.lit("."))


def folder_of(path: str | Column) -> Column:
    """The folders of a relative path, the category of its file."""
    return F.regexp_replace(F.regexp_replace(tx.col(path), r"\\", "/"), r"/?[^/]*$", "")


def stem(path: str | Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(F.regexp_replace(tx.col(path), r"\\", "/"), "/"), -1), r"\.[^.]*$", "")


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(path, category, doc_id, ext, content) of the files below a folder; contents are read only where used."""
    # names are tested where files are listed, so no other file is opened
    known = "{" + ",".join(f"*.{e},*.{e.upper()}" for e in SUPPORTED) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", known).load(root)
    base = root.rstrip("/")
    relative = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/+", "/"), "^" + base.replace(".", r"\.") + "/?", "")
    rows = files.select(relative.alias("path"), "content").filter(is_read("path"))
    last = base.rsplit("/", 1)[-1]
    return rows.select("path", F.coalesce(tx.filled(folder_of("path")), F.lit(last)).alias("category"), stem("path").alias("doc_id"), extension("path").alias("ext"), "content")


def file_counts(paths: DataFrame) -> DataFrame:
    """(ext, files): distinct supported files by extension."""
    return paths.select("path").distinct().filter(is_read("path")).groupBy(extension("path").alias("ext")).agg(F.count(F.lit(1)).alias("files"))


def lines(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, n, line): the non-blank lines, trimmed, numbered from 0 without gaps; a null text has none."""
    own = F.filter(F.transform(F.split(tx.col(text), r"\r\n|\n|\r"), lambda x: F.trim(x)), lambda x: x != "")
    return rows.select(F.col(key).alias("key"), F.posexplode(own).alias("n", "line"))


def delimiter(sample: str | Column) -> Column:
    """The delimiter that occurs most in the first line; `;` where none does."""
    first = F.split(tx.col(sample), r"\r?\n")[0]
    counts = F.array(*[F.struct(F.size(F.split(first, "\\" + d if d == "|" else d)).alias("n"), F.lit(-k).alias("k"), F.lit(d).alias("d")) for k, d in enumerate(DELIMITERS)])
    most = F.array_max(counts)
    return F.when(most["n"] > 1, most["d"]).otherwise(";")


def csv_rows(files: DataFrame) -> DataFrame:
    """(path, n, text) of CSV files (path, text): `header: value; …` where the widths agree, else the values; blank rows are left out.

    Cells may be quoted, with delimiters, doubled quotes and line ends in them.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, text, sep in zip(batch.path, batch.text, batch.sep):
                reader = csv.reader(io.StringIO(text or "", newline=""), delimiter=sep)
                head = [x.strip() for x in next(reader, [])]
                for n, cells in enumerate(x for x in ([c.strip() for c in row] for row in reader) if any(x)):
                    rows.append((path, n, "; ".join(f"{h}: {v}" for h, v in zip(head, cells)) if len(head) == len(cells) else "; ".join(cells)))
            yield pd.DataFrame(rows, columns=["path", "n", "text"])

    return files.select("path", "text", delimiter("text").alias("sep")).mapInPandas(run, "path string, n int, text string")


def elements_of(files: DataFrame) -> DataFrame:
    """Elements of scanned files (path, category, doc_id, ext, content), all formats united.

    PDF and DOC need a parser registered in PLUGINS; without one their files are reported as an error row.
    """
    texts = files.filter(F.col("ext").isin("txt", "csv", "html", "htm", "md")).withColumn("text", charset.decoded()("content")["text"])
    by_path = files.select("path", "category", "doc_id", "ext")
    none = F.lit(None).cast("string")

    def shaped(rows: DataFrame, kind, part=none, media=none, error=none) -> DataFrame:
        return rows.select("path", F.col("n").cast("int").alias("elem_order"), kind.alias("element_type"), "text", part.alias("part"), media.alias("media_path"), error.alias("error"))

    parts = [shaped(lines(texts.filter("ext = 'txt'"), "path").select(F.col("key").alias("path"), "n", F.col("line").alias("text")), F.lit("paragraph")), shaped(csv_rows(texts.filter("ext = 'csv'")), F.lit("row"))]
    for names, md in ((("html", "htm"), False), (("md",), True)):
        pages = markup.parsed(texts.filter(F.col("ext").isin(*names)).select(F.col("path").alias("key"), F.col("text").alias("html")), md)
        parts.append(shaped(pages.withColumnRenamed("key", "path"), F.col("element_type"), media=F.col("media")))
    parts.append(shaped(office.parsed(files.filter(F.col("ext").isin(*office.READERS))), F.col("element_type"), F.col("part"), error=F.col("error")))
    for ext in ("pdf", "doc", "xls"):
        own = files.filter(F.col("ext") == ext)
        parts.append(PLUGINS[ext](own) if ext in PLUGINS else own.select("path", F.lit(0).alias("elem_order"), none.alias("element_type"), none.alias("text"), none.alias("part"), none.alias("media_path"), F.lit(f"no parser is registered for {ext}").alias("error")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    full = rows.join(by_path, "path")
    meta = F.map_filter(F.create_map(F.lit("part"), "part", F.lit("error"), "error"), lambda k, v: v.isNotNull())
    return full.select(
        F.md5(F.concat_ws("\u0001", tx.doc_key("category", "doc_id", "path"), F.col("elem_order").cast("string"))).alias("id"), "category", F.col("path").alias("doc_path"), "doc_id", F.col("ext").alias("source_type"),
        F.when(F.col("ext") == "pptx", F.col("part").cast("int")).alias("page"), "elem_order", F.lit(None).cast("array<double>").alias("bbox"), "element_type", "text", none.alias("html"), "media_path",
        F.lit(None).cast("array<string>").alias("headings_path"), F.lit(None).cast("array<string>").alias("parents"), meta.alias("metadata"),
    )


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """Elements from JSON lines, with the engine's schema."""
    return spark.read.schema(schema.ELEMENTS).json(path)


def two_means(values: Column, rounds: int = 12) -> Column:
    """The threshold between two columns of block centres, or null: below 8 values, or fewer than 3 on a side.

    One-dimensional 2-means from the least and the greatest value, a fixed number of rounds.
    """
    start = F.struct(F.array_min(values).alias("a"), F.array_max(values).alias("b"))

    def step(c: Column, _: Column) -> Column:
        left = F.filter(values, lambda x: F.abs(x - c["a"]) <= F.abs(x - c["b"]))
        right = F.filter(values, lambda x: F.abs(x - c["a"]) > F.abs(x - c["b"]))
        mean = lambda v, old: F.when(F.size(v) > 0, F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)).otherwise(old)
        return F.struct(mean(left, c["a"]).alias("a"), mean(right, c["b"]).alias("b"))

    ends = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step, lambda c: (c["a"] + c["b"]) / 2)
    sides = F.least(F.size(F.filter(values, lambda x: x <= ends)), F.size(F.filter(values, lambda x: x > ends)))
    return F.when((F.size(values) >= 8) & (sides >= 3), ends)


def block_order(blocks: DataFrame) -> DataFrame:
    """Blocks (doc_key, page, id, bbox) with their reading order on the page: left column, right column, each from the top."""
    centres = blocks.groupBy("doc_key", "page").agg(F.array_sort(F.collect_list(F.round((F.get("bbox", F.lit(0)) + F.get("bbox", F.lit(2))) / 2, 6))).alias("centres"))
    split = centres.select(F.col("doc_key").alias("k"), F.col("page").alias("p"), two_means(F.col("centres")).alias("threshold"))
    placed = blocks.join(split, F.expr("doc_key <=> k and page <=> p")).select("doc_key", "page", "id", "bbox", "threshold")
    column = F.when(F.col("threshold").isNotNull() & ((F.get("bbox", F.lit(0)) + F.get("bbox", F.lit(2))) / 2 > F.col("threshold")), 1).otherwise(0)
    order = Window.partitionBy("doc_key", "page").orderBy("col_no", F.get("bbox", F.lit(1)), F.get("bbox", F.lit(0)), "id")
    return placed.withColumn("col_no", column).withColumn("n", F.row_number().over(order) - 1).select("doc_key", "page", "id", "col_no", "n")
