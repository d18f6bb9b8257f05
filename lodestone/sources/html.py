"""HTML pages: blocks, metadata and visible text. Parsing is per page, inside Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements whose text is no content, and those of them that have no end tag (fixed values).
SKIP = {
    "script", "style", "noscript", "iframe", "svg", "canvas", "template", "form", "input", "button", "object", "embed", "audio", "video", "source", "track",
    "nav", "footer", "header",
}
VOID = {"input", "embed", "source", "track"}
BLOCKS = {"p": "paragraph", "li": "list_item", "blockquote": "blockquote", "pre": "code_block"} | {f"h{i}": "heading" for i in range(1, 7)}
SCHEMA = "page_id long, place long, kind string, level int, text string"
TYPES = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string()]
#: Pages that are parsed before their blocks are handed on.
AT_ONCE = 32


class _Blocks(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, int, str]] = []
        self.skipped = 0
        self.open: str | None = None
        self.text: list[str] = []

    def close_block(self) -> None:
        text = re.sub(r"\s+", " ", "".join(self.text)).strip()
        if self.open and text:
            self.found.append((BLOCKS[self.open], int(self.open[1]) if self.open[0] == "h" else 0, text))
        self.open, self.text = None, []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SKIP:
            self.skipped += tag not in VOID
        elif tag in BLOCKS and not self.skipped:
            self.close_block()
            self.open = tag

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIP:
            self.skipped = max(0, self.skipped - (tag not in VOID))
        elif tag == self.open:
            self.close_block()

    def handle_data(self, data: str) -> None:
        if self.open and not self.skipped:
            self.text.append(data)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, AT_ONCE):
            out = []
            for page, html in zip(*(c.to_pylist() for c in batch.slice(k, AT_ONCE).columns)):
                parser = _Blocks()
                parser.feed(html or "")
                parser.close_block()
                out += [(page, place, *x) for place, x in enumerate(parser.found)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate(TYPES)], [c.split()[0] for c in SCHEMA.split(", ")])


def html_blocks(pages: DataFrame) -> DataFrame:
    """The blocks of each page. Pages of a batch are parsed a few at a time, and what they give is handed on before the next ones."""
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).mapInArrow(_parsed, SCHEMA)


def title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def language(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<html[^>]*\slang=[\"']?([A-Za-z-]+)", 1)


def visible_text(html: Column) -> Column:
    """Text between tags, with scripts and styles left out, line ends at blocks and single spaces elsewhere."""
    text = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>|<!--.*?-->", "")
    text = F.regexp_replace(text, r"(?i)<(br|/p|/h[1-6]|/li|/div|/title)[^>]*>", "\n")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", "")
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r" ?\n ?", "\n")
    return F.trim(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def article_html(envelope: Column, prefix: str = "var article =") -> Column:
    """HTML of an article that a site wraps in JSON: code must be 0, and data an assignment of an object with topic, content, summary and
    authors. Null where it is not so, or where both topic and content are empty."""
    outer = F.from_json(envelope, "code string, data string")
    body = F.rtrim(F.trim(F.substring(outer["data"], len(prefix) + 1, 1 << 30)), F.lit(";"))
    article = F.from_json(F.when((outer["code"] == "0") & F.startswith(outer["data"], F.lit(prefix)), body), "topic string, content string, summary string, authors string")
    field = lambda name: F.coalesce(F.trim(article[name]), F.lit(""))

    def escaped(text: Column) -> Column:
        for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
            text = F.replace(text, F.lit(sign), F.lit(name))
        return text

    meta = lambda name, value: F.when(value != "", F.concat(F.lit(f'<meta name="{name}" content="'), escaped(value), F.lit('">'))).otherwise("")
    html = F.concat(F.lit("<title>"), escaped(field("topic")), F.lit("</title>"), meta("description", field("summary")), meta("author", field("authors")), F.lit("<article>"), field("content"), F.lit("</article>"))
    return F.when(article.isNotNull() & ((field("topic") != "") | (field("content") != "")), html)
