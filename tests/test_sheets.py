"""Regions of sheets from workbooks made by hand, and of cells given as rows."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestone.operators import sheets
from lodestone.sources import office

BOOK = """<?xml version="1.0"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheets><sheet name="Sales" sheetId="1"/><sheet name="Notes" sheetId="2"/></sheets></workbook>"""
STRINGS = """<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>customer name</t></si><si><t>amount</t></si><si><r><t>An</t></r><r><t>na</t></r></si><si><t>Total</t></si></sst>"""
SALES = """<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>
<row r="2"><c r="B2" t="s"><v>0</v></c><c r="C2" t="s"><v>1</v></c></row>
<row r="3"><c r="B3" t="s"><v>2</v></c><c r="C3"><v>12.5</v></c><c r="ZZ3" s="4"/></row>
<row r="4"><c r="B4" t="inlineStr"><is><t>Bo</t></is></c><c r="C4"><f>C3*2</f><v>25</v></c></row>
<row r="7"><c r="A7" t="s"><v>0</v></c><c r="B7" t="s"><v>1</v></c></row><row r="8"><c r="A8" t="s"><v>2</v></c><c r="B8"><v>1</v></c></row><row r="9"><c r="A9" t="s"><v>3</v></c><c r="B9"><v>1</v></c></row>
<row r="1048576"><c r="A1048576" s="1"/></row></sheetData></worksheet>"""
NOTES = """<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="2"><c r="A2" t="b"><v>1</v></c></row></sheetData><mergeCells><mergeCell ref="A1:A2"/><mergeCell ref="AA5"/></mergeCells></worksheet>"""


@pytest.fixture(scope="module")
def files(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in (("xl/workbook.xml", BOOK), ("xl/sharedStrings.xml", STRINGS), ("xl/worksheets/sheet1.xml", SALES), ("xl/worksheets/sheet2.xml", NOTES)):
            z.writestr(name, body)
    return spark.createDataFrame([("book", bytearray(out.getvalue()))], "path string, content binary")


def test_regions_of_a_workbook(files):
    cells, merges = office.workbooks(files), office.merged_ranges(files)
    assert [tuple(r)[1:] for r in merges.collect()] == [("Notes", 1, 1, 2, 1), ("Notes", 5, 27, 5, 27)]
    rows = sheets.region_rows(cells.select("sheet", "row_number", "column_number", "cell"))
    found = sheets.regions(rows, merges.select("sheet", "r1", "c1", "r2", "c2"))
    got = {(r.sheet, r.region): r for r in found.collect()}
    first = got["Sales", 1]
    assert (first.row_start, first.row_end, first.header_row, first.columns, first.risks) == (2, 4, 2, ["A列", "customer name", "amount"], [])
    assert got["Sales", 2].risks == ["summary_rows"] and got["Sales", 2].columns == ["A列", "B列"] and got["Sales", 2].header_row is None
    assert got["Notes", 1].risks == ["merged_cells", "separated_columns", "mixed_single_cell_rows"] and len(got) == 3  # cells that have a style alone make no region
    lines = {(r.sheet, r.row_number): r.line for r in sheets.row_lines(rows, found).collect()}
    assert lines["Sales", 4] == "行 4｜customer name=Bo｜amount=25" and lines["Notes", 2] == "行 2｜A列=TRUE" and ("Sales", 2) not in lines


@pytest.mark.parametrize("rows, headed", [
    ([["id", "x"], ["1", "2"]], True), ([["a", "b"], ["1", "c"]], True), ([["a", "b"], ["c", "d"]], False), ([["a", "a"], ["1", "2"]], False), ([["id", "7"], ["1", "2"]], False), ([["id", "=A1"], ["1", "2"]], False),
    ([["only"], ["1"]], False), ([["id", "x"]], False), ([["b" * 30, "c"], ["1", "2"]], False), ([["b" * 41, "date"], ["1", "2"]], False),
])
def test_headers(spark, rows, headed):
    cells = [("s", r, c, text) for r, row in enumerate(rows, 1) for c, text in enumerate(row, 1)]
    own = sheets.region_rows(spark.createDataFrame(cells, "sheet string, row_number long, column_number int, cell string"))
    none = spark.createDataFrame([], "sheet string, r1 long, c1 int, r2 long, c2 int")
    assert ("unconfirmed_header" not in sheets.regions(own, none).first().risks) == headed


def test_names_of_columns(spark):
    numbers = [1, 26, 27, 52, 702, 703, 16384]
    rows = spark.createDataFrame([(n,) for n in numbers], "n int").select("n", sheets.letters(F.col("n")).alias("x")).collect()
    assert {r.n: r.x for r in rows} == {1: "A", 26: "Z", 27: "AA", 52: "AZ", 702: "ZZ", 703: "AAA", 16384: "XFD"}
    cells = [("s", 1, 1, "B列"), ("s", 1, 3, "name"), ("s", 2, 1, "1"), ("s", 2, 2, "2"), ("s", 2, 3, "3")]
    own = sheets.region_rows(spark.createDataFrame(cells, "sheet string, row_number long, column_number int, cell string"))
    none = spark.createDataFrame([], "sheet string, r1 long, c1 int, r2 long, c2 int")
    assert sheets.regions(own, none).first().columns == ["B列", "B列_2", "name"]
