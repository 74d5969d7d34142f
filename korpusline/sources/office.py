"""DOCX, PPTX and XLSX to elements, from their XML (standard library only)."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
M = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"

Item = tuple[str, str, str | None]


def _text(node: ElementTree.Element, tag: str) -> str:
    return "".join(t.text or "" for t in node.iter(tag))


def docx_items(content: bytes) -> Iterator[Item]:
    """Paragraphs, then one table element per row, then formulas."""
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
    body = root.find(f"{W}body")
    for p in body.iterfind(f"{W}p"):
        if text := _text(p, f"{W}t").strip():
            yield "paragraph", text, None
    for row in root.iter(f"{W}tr"):
        cells = [" ".join(filter(None, (_text(p, f"{W}t").strip() for p in c.iter(f"{W}p")))) for c in row.iterfind(f"{W}tc")]
        if any(cells):
            yield "table", "\t".join(cells), None
    for formula in root.iter(f"{M}oMath"):
        yield "formula", _text(formula, f"{M}t"), None


def pptx_items(content: bytes) -> Iterator[Item]:
    """Per slide: paragraphs of its shapes, rows of its tables, then a slide boundary."""
    archive = zipfile.ZipFile(io.BytesIO(content))
    slides = sorted((int(m[1]), n) for n in archive.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
    for number, name in slides:
        root = ElementTree.fromstring(archive.read(name))
        in_tables = {p for t in root.iter(f"{A}tbl") for p in t.iter(f"{A}p")}
        for p in root.iter(f"{A}p"):
            if p not in in_tables and (text := _text(p, f"{A}t").strip()):
                yield "paragraph", text, str(number)
        for row in root.iter(f"{A}tr"):
            yield "table", "\t".join(_text(c, f"{A}t").strip() for c in row.iterfind(f"{A}tc")), str(number)
        yield "slide", f"Slide {number}", str(number)


def xlsx_items(content: bytes) -> Iterator[Item]:
    """Per sheet and row: `column: value` of all columns; empty cells read nan."""
    archive = zipfile.ZipFile(io.BytesIO(content))
    shared = []
    if "xl/sharedStrings.xml" in archive.namelist():
        shared = [_text(x, f"{S}t") for x in ElementTree.fromstring(archive.read("xl/sharedStrings.xml")).iterfind(f"{S}si")]
    book = ElementTree.fromstring(archive.read("xl/workbook.xml"))
    for n, sheet in enumerate(book.iter(f"{S}sheet"), 1):
        root = ElementTree.fromstring(archive.read(f"xl/worksheets/sheet{n}.xml"))
        rows = []
        for row in root.iter(f"{S}row"):
            cells = {}
            for k, c in enumerate(row.iterfind(f"{S}c")):
                at = re.match(r"[A-Z]+", c.get("r", ""))
                place = sum((ord(x) - 64) * 26**p for p, x in enumerate(reversed(at[0]))) - 1 if at else k
                value = c.find(f"{S}v")
                text = _text(c, f"{S}t") if c.get("t") == "inlineStr" else "" if value is None else shared[int(value.text)] if c.get("t") == "s" else value.text
                cells[place] = text
            rows.append(cells)
        if not rows:
            continue
        width = max(max(r, default=-1) for r in rows) + 1
        head = [rows[0].get(k) or f"Unnamed: {k}" for k in range(width)]
        for r in rows[1:]:
            yield "row", "; ".join(f"{head[k]}: {r.get(k) or 'nan'}" for k in range(width)), sheet.get("name")


READERS = {"docx": docx_items, "pptx": pptx_items, "xlsx": xlsx_items}


def parsed(files: DataFrame) -> DataFrame:
    """(path, n, element_type, text, part, error) of files (path, content); part: slide or sheet.

    A file that can't be read gives one row with its error, so that one bad file fails no job.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.path, batch.content):
                reader = READERS.get(path.rsplit(".", 1)[-1].lower())
                try:
                    rows += [(path, n, kind, text, part, None) for n, (kind, text, part) in enumerate(reader(bytes(content)) if reader else ())]
                except Exception as e:  # noqa: BLE001
                    rows.append((path, 0, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "n", "element_type", "text", "part", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, n int, element_type string, text string, part string, error string")
