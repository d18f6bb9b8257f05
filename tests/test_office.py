import io
import zipfile

from lodestone.sources import office


def package(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name.replace("__", "/"), body)
    return out.getvalue()


WORKBOOK = {
    "xl__workbook.xml": '<workbook xmlns="x"><sheets><sheet name="Sales"/></sheets></workbook>',
    "xl__sharedStrings.xml": '<sst xmlns="x"><si><t>name</t></si><si><r><t>two </t></r><r><t>runs</t></r></si></sst>',
    "xl__worksheets__sheet1.xml": '<worksheet xmlns="x"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="AB1" t="s"><v>1</v></c></row><row r="3"><c r="B3"><f>A1</f><v>7.5</v></c><c r="C3" t="b"><v>1</v></c><c r="D3" s="4"/><c r="E3" t="inlineStr"><is><t>a\nb</t></is></c></row></sheetData></worksheet>',
}
DOCUMENT = (
    '<w:document xmlns:w="w"><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p>'
    "<w:p><w:r><w:t>kept </w:t></w:r><w:del><w:r><w:t>gone</w:t></w:r></w:del><w:ins><w:r><w:t>new</w:t></w:r></w:ins></w:p><w:p/>"
    "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"
)


def test_workbook_cells():
    assert office.sheet_cells(package(**WORKBOOK)) == [("Sales", 1, 1, "name"), ("Sales", 1, 28, "two runs"), ("Sales", 3, 2, "7.5"), ("Sales", 3, 3, "TRUE"), ("Sales", 3, 5, "a↵b")]


def test_document_paragraphs():
    assert office.paragraphs(package(**{"word__document.xml": DOCUMENT})) == [("heading", 2, "Title"), ("paragraph", 0, "kept new"), ("table", 0, "a | b")]


def test_files_through_spark(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.xlsx").write_bytes(package(**WORKBOOK))
    (tmp_path / "in" / "b.docx").write_bytes(package(**{"word__document.xml": DOCUMENT}))
    folder = f"file://{tmp_path}/in"
    assert office.workbooks(office.read_files(spark, folder, "*.xlsx")).count() == 5
    assert [r.kind for r in office.text_documents(office.read_files(spark, folder, "*.docx")).orderBy("place").collect()] == ["heading", "paragraph", "table"]
