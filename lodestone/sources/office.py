"""Workbooks and text documents in Office Open XML, read with the standard library: files come as rows of Spark's binaryFile
source, and each is parsed in the task that reads it."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

CELLS = "path string, sheet string, row_number long, column_number int, cell string"
MERGES = "path string, sheet string, r1 long, c1 int, r2 long, c2 int"
PARAGRAPHS = "path string, place long, kind string, level int, text string"
#: Parts of a package that are larger than this are refused.
MAX_PART = 256 << 20


def read_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """path and content of the files below a folder whose names fit the pattern."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "content")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _part(package: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    if name not in package.namelist():
        return None
    if package.getinfo(name).file_size > MAX_PART:
        raise ValueError(f"{name} is too large")
    return ElementTree.fromstring(package.read(name))


def _text(node: ElementTree.Element) -> str:
    return "".join(x.text or "" for x in node.iter() if _local(x.tag) == "t")


def _column(reference: str) -> int:
    number = 0
    for letter in re.match(r"[A-Z]+", reference)[0]:
        number = number * 26 + ord(letter) - 64
    return number


def _sheets(package: zipfile.ZipFile) -> list[tuple[str, str]]:
    """Name and part of each sheet, in order."""
    book = _part(package, "xl/workbook.xml")
    names = [x.get("name") for x in book.iter() if _local(x.tag) == "sheet"] if book is not None else []
    parts = sorted((n for n in package.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
    return [(names[k] if k < len(names) else part, part) for k, part in enumerate(parts)]


def sheet_cells(content: bytes) -> list[tuple[str, int, int, str]]:
    """sheet, row, column and shown text of each cell with a value; a formula shows its kept value."""
    package = zipfile.ZipFile(io.BytesIO(content))
    shared = _part(package, "xl/sharedStrings.xml")
    strings = [_text(x) for x in shared] if shared is not None else []
    found = []
    for name, part in _sheets(package):
        for cell in (x for x in _part(package, part).iter() if _local(x.tag) == "c"):
            value = next((x.text for x in cell if _local(x.tag) == "v"), None)
            kind = cell.get("t")
            text = _text(cell) if kind == "inlineStr" else strings[int(value)] if kind == "s" and value else {"1": "TRUE", "0": "FALSE"}.get(value, value) if kind == "b" else value
            if text:
                where = cell.get("r")
                found.append((name, int(re.search(r"\d+", where)[0]), _column(where), text.replace("\n", "↵")))
    return found


def sheet_merges(content: bytes) -> list[tuple[str, int, int, int, int]]:
    """sheet, first and last row and column of each merged range."""
    package = zipfile.ZipFile(io.BytesIO(content))
    found = []
    for name, part in _sheets(package):
        for merge in (x for x in _part(package, part).iter() if _local(x.tag) == "mergeCell"):
            ends = merge.get("ref").split(":")
            places = [(int(re.search(r"\d+", e)[0]), _column(e)) for e in (ends[0], ends[-1])]
            found.append((name, *places[0], *places[1]))
    return found


def paragraphs(content: bytes) -> list[tuple[str, int, str]]:
    """kind, level and final text (insertions kept, deletions left out) of paragraphs and table rows in body order."""
    body = next(iter(_part(zipfile.ZipFile(io.BytesIO(content)), "word/document.xml")))
    found: list[tuple[str, int, str]] = []

    def final_text(node: ElementTree.Element) -> str:
        return "" if _local(node.tag) in ("del", "moveFrom") else (node.text or "") if _local(node.tag) == "t" else "\n" if _local(node.tag) == "br" else "".join(map(final_text, node))

    for node in body:
        if _local(node.tag) == "tbl":
            for row in (x for x in node if _local(x.tag) == "tr"):
                text = " | ".join(final_text(cell).strip() for cell in row if _local(cell.tag) == "tc")
                found.append(("table", 0, text))
        elif _local(node.tag) == "p" and (text := final_text(node).strip()):
            style = next((v for x in node.iter() if _local(x.tag) == "pStyle" for v in x.attrib.values()), "")
            heading = re.fullmatch(r"(?i)heading ?(\d)|标题 ?(\d)", style)
            found.append(("heading", int(heading[1] or heading[2]), text) if heading else ("paragraph", 0, text))
    return found


def _per_file(parse, schema: str):
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                yield pd.DataFrame(parse(path, content), columns=names)

    return run


def workbooks(files: DataFrame) -> DataFrame:
    return files.mapInPandas(_per_file(lambda path, content: [(path, *x) for x in sheet_cells(content)], CELLS), CELLS)


def merged_ranges(files: DataFrame) -> DataFrame:
    return files.mapInPandas(_per_file(lambda path, content: [(path, *x) for x in sheet_merges(content)], MERGES), MERGES)


def text_documents(files: DataFrame) -> DataFrame:
    return files.mapInPandas(_per_file(lambda path, content: [(path, k, *x) for k, x in enumerate(paragraphs(content))], PARAGRAPHS), PARAGRAPHS)


def _zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as package:
        for name, body in parts.items():
            package.writestr(name, body)
    return out.getvalue()


def workbook_bytes(sheet: str, rows: list[list[str | None]]) -> bytes:
    """A workbook of one sheet with text cells; empty cells are left out."""
    letters = lambda k: (letters(k // 26 - 1) if k >= 26 else "") + chr(65 + k % 26)
    cell = lambda r, k, text: f'<c r="{letters(k)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'
    body = "".join(f'<row r="{r}">{"".join(cell(r, k, text) for k, text in enumerate(row) if text)}</row>' for r, row in enumerate(rows, 1))
    quoted = escape(sheet, {'"': "&quot;"})
    return _zipped({
        "xl/workbook.xml": f'<workbook xmlns="x"><sheets><sheet name="{quoted}" sheetId="1"/></sheets></workbook>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="x"><sheetData>{body}</sheetData></worksheet>',
    })


def document_bytes(parts: list[tuple[str, str]]) -> bytes:
    """A text document of parts: heading, paragraph, deleted (a tracked deletion) or table (one row, cells divided by tabs)."""
    run = lambda text, tag="w:t": f'<w:r><{tag} xml:space="preserve">{escape(text)}</{tag}></w:r>'
    shapes = {
        "heading": lambda x: f'<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr>{run(x)}</w:p>',
        "paragraph": lambda x: f"<w:p>{run(x)}</w:p>",
        "deleted": lambda x: f"<w:p><w:del>{run(x)}</w:del></w:p>",
        "table": lambda x: "<w:tbl><w:tr>" + "".join(f"<w:tc><w:p>{run(c)}</w:p></w:tc>" for c in x.split("\t")) + "</w:tr></w:tbl>",
    }
    body = "".join(shapes[kind](text) for kind, text in parts)
    return _zipped({"word/document.xml": f'<w:document xmlns:w="w"><w:body>{body}</w:body></w:document>'})
