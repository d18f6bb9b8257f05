import json

import pytest
from pyspark.sql import functions as F

from lodestone.operators import profile
from lodestone.plans import limits, loop
from lodestone.plans.model import Field, PlanError
from lodestone.sources import html, office
from lodestone.streaming import jobs


def test_office_round_trip():
    rows = [["a & b", None, "<c>"], [], ["x"] * 30]
    cells = office.sheet_cells(office.workbook_bytes('q"s', rows))
    assert cells[:2] == [('q"s', 1, 1, "a & b"), ('q"s', 1, 3, "<c>")] and cells[-1] == ('q"s', 3, 30, "x") and len(cells) == 32
    parts = [("heading", "T"), ("deleted", "no"), ("paragraph", "a < b"), ("table", "1\t2")]
    assert office.paragraphs(office.document_bytes(parts)) == [("heading", 1, "T"), ("paragraph", 0, "a < b"), ("table", 0, "1 | 2")]


@pytest.mark.parametrize("question, values, enough", [
    ("what is open", ["open"], False), ("status: open?", ["open"], True), ("状态为完成的有什么", ["完成"], True), ("状态完成", ["完成"], False), ("STATUS = Open", ["open"], True), ("x = a\\Eb?", ["a\\Eb"], True),
    ("x = a.b", ["axb"], False), ("open in north", ["open", "north"], True), ("open in north on 2024-03-01", ["open", "north"], False), ("open on 3月1日", ["open", "3月1日"], True), ("anything", [], False),
])
def test_literals_suffice(spark, question, values, enough):
    found = F.array(*map(F.lit, values)).cast("array<string>")
    assert spark.range(1).select(profile.literals_suffice(F.lit(question), found)).first()[0] is enough


def test_article_html(spark):
    wrap = lambda code, article: json.dumps({"code": code, "data": "var article = " + json.dumps(article) + ";"})
    cases = [wrap("0", {"topic": " a<b ", "content": "<p>x;</p>"}), wrap("1", {"topic": "a"}), wrap("0", {"topic": " ", "content": ""}), "no json", None, json.dumps({"code": "0", "data": "other = {}"})]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in cases], "e string").select(html.article_html(F.col("e"))).collect()]
    assert got == ["<title>a&lt;b</title><article><p>x;</p></article>"] + [None] * 5


def test_a_long_page_is_cancelled(spark):
    page = spark.range(10**13).select(F.sum(F.xxhash64("id") % 7))
    with pytest.raises(PlanError) as error:
        limits.page_within(page, 3)
    assert error.value.code == "query_timeout"
    assert limits.page_within(spark.range(2), 60) == spark.range(2).collect()


FIELDS = [Field("town"), Field("cost", "number")]


def test_plan_loop(spark):
    rows = spark.createDataFrame([(1, "north", "5"), (2, "south", "7")], "row_number long, town string, cost string")
    draft = {"metric": "rows", "filters": [{"column": "cost", "operator": "gt", "value": 6}], "offset": 5}
    ask = lambda drafts, more=None: loop.answer(rows, FIELDS, "some", drafts, more)
    assert loop.answer(rows, FIELDS, "town: north?", []).rows[0]["row_number"] == 1
    assert ask([draft]).rows == [] and ask([draft], draft).origin == "draft"
    assert [r["row_number"] for r in ask([draft], draft | {"offset": 0}).rows] == [2]
    assert ask([draft], {"metric": "rows", "offset": 0}).origin == "draft"  # other filters are no refinement
    with pytest.raises(PlanError):
        ask([{"metric": "most"}, {"limit": -1}, draft])


def test_a_cancelled_scan_goes_on(spark, tmp_path):
    spark.range(80).repartition(8).write.parquet(f"{tmp_path}/in")
    run = lambda **more: jobs.scan_folder(spark, f"{tmp_path}/in", "id long", f"{tmp_path}/out", f"{tmp_path}/state", **more)
    assert not run(stop_before=1)
    first = spark.read.parquet(f"{tmp_path}/out").count()
    assert 0 < first < 80 and run() and sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(80))
