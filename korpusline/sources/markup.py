"""HTML and Markdown to elements, on the standard library's parser."""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

# What a tag becomes.
TAGS = {**{f"h{n}": "title" for n in range(1, 7)}, "p": "paragraph", "li": "list", "pre": "paragraph", "code": "paragraph", "table": "table", "img": "image"}
SKIPPED = {"script", "style", "head", "noscript", "template"}
BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "table", "pre", "div", "section", "article", "nav", "footer", "header", "blockquote"}
VOID = {"br", "hr", "img", "input", "meta", "link", "col", "area", "base", "embed", "source", "track", "wbr"}


class ElementParser(HTMLParser):
    """Elements in document order: an element starts with its tag and takes all text inside, nested ones emit again.

    A block tag closes an open paragraph, a list item an open item of the same list; what is open at the
    end is closed there.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[dict] = []
        self.stack: list[tuple[str, dict | None]] = []
        self.silent = 0

    def _open(self) -> list[dict]:
        return [e for _, e in self.stack if e is not None]

    def _pop(self, tag: str) -> None:
        if any(t == tag for t, _ in self.stack):
            while self.stack:
                t, _ = self.stack.pop()
                if t in SKIPPED:
                    self.silent -= 1
                if t == tag:
                    break

    def handle_starttag(self, tag: str, attrs: list) -> None:
        names = [t for t, _ in self.stack]
        if tag in BLOCKS and "p" in names:
            self._pop("p")
        if tag == "li" and "li" in names and not {"ul", "ol"} & set(names[len(names) - names[::-1].index("li") :]):
            self._pop("li")
        if tag in ("tr", "td", "th"):
            for e in self._open():
                if e["type"] == "table":
                    e["text"] += "\n" if tag == "tr" else "\t"
        if tag == "br":
            for e in self._open():
                e["text"] += "\n"
        element = None
        if tag in TAGS and not self.silent:
            element = {"type": TAGS[tag], "text": "", "media": dict(attrs).get("src") if tag == "img" else None, "tag": tag}
            self.found.append(element)
        if tag not in VOID:
            self.stack.append((tag, element))
            self.silent += tag in SKIPPED

    def handle_endtag(self, tag: str) -> None:
        self._pop(tag)

    def handle_data(self, data: str) -> None:
        if not self.silent:
            for e in self._open():
                e["text"] += data


def tidy(element: dict) -> str:
    if element["type"] == "table":
        rows = [[re.sub(r"\s+", " ", c).strip() for c in r.split("\t")] for r in element["text"].split("\n")]
        return "\n".join("\t".join(r[1:]) if len(r) > 1 else r[0] for r in rows if any(r))
    if element["tag"] in ("pre", "code"):
        return element["text"].strip("\n")
    return re.sub(r"\s+", " ", element["text"]).strip()


def html_elements(html: str | None) -> list[tuple[str, str, str | None]]:
    """(element type, text, media source) in document order; elements without text or media are left out."""
    if not html:
        return []
    parser = ElementParser()
    parser.feed(html)
    parser.close()
    return [(e["type"], text, e["media"]) for e in parser.found if (text := tidy(e)) or e["media"]]


def markdown_html(text: str) -> str:
    """Headings, lists, fenced code, pipe tables, images and paragraphs of Markdown as HTML."""
    out: list[str] = []
    lines = text.split("\n")
    n = 0
    while n < len(lines):
        line = lines[n]
        if m := re.match(r"(#{1,6})\s+(.*)", line):
            out.append(f"<h{len(m[1])}>{html_lib.escape(m[2].strip())}</h{len(m[1])}>")
        elif line.startswith("```"):
            end = next((k for k in range(n + 1, len(lines)) if lines[k].startswith("```")), len(lines))
            out.append("<pre>" + html_lib.escape("\n".join(lines[n + 1 : end])) + "</pre>")
            n = end
        elif m := re.match(r"\s*(?:[-*+]|\d+[.)])\s+(.*)", line):
            out.append(f"<ul><li>{html_lib.escape(m[1])}</li></ul>")
        elif line.lstrip().startswith("|"):
            end = next((k for k in range(n, len(lines)) if not lines[k].lstrip().startswith("|")), len(lines))
            rows = [[c.strip() for c in x.strip().strip("|").split("|")] for x in lines[n:end] if not re.fullmatch(r"[\s|:\-]+", x)]
            out.append("<table>" + "".join("<tr>" + "".join(f"<td>{html_lib.escape(c)}</td>" for c in r) + "</tr>" for r in rows) + "</table>")
            n = end - 1
        elif line.strip():
            end = next((k for k in range(n, len(lines)) if not lines[k].strip()), len(lines))
            body = html_lib.escape(" ".join(lines[n:end]))
            out.append("<p>" + re.sub(r"!\[([^\]]*)\]\(([^)\s]+)\)", r'<img alt="\1" src="\2">', body) + "</p>")
            n = end
        n += 1
    return "\n".join(out)


def parsed(pages: DataFrame, markdown: bool = False) -> DataFrame:
    """(key, n, element_type, text, media) of pages (key, html), n from 0; a null page gives no rows."""
    kind = pages.select("key").schema[0].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, page in zip(batch.key, batch.html):
                rows += [(key, n, *e) for n, e in enumerate(html_elements(markdown_html(page) if markdown and page else page))]
            yield pd.DataFrame(rows, columns=["key", "n", "element_type", "text", "media"])

    return pages.select("key", "html").mapInPandas(run, f"key {kind}, n int, element_type string, text string, media string")
