import pytest

from lodestone.plans import compiler, units
from lodestone.plans.model import Field, Plan, PlanError, validate, validate_drafted

FIELDS = [Field("地区", "text", ("harbour", "all-harbour", "all-hills")), Field("金额", "number"), Field("日期", "date")]
ROWS = [(1, "harbour", "4.50（原始值：4.5）"), (2, "harbour", "11"), (3, "hills", "6"), (4, "all-harbour", "21"), (5, "all-hills", "8.5"), (6, "all-harbour-pier", "77"), (7, "back\\slash", "1")]


@pytest.fixture(scope="module")
def sales(spark):
    return spark.createDataFrame([(*r, "2026-07-31") for r in ROWS], "row_number long, `地区` string, `金额` string, `日期` string")


def run(rows, raw, fields=FIELDS):
    return [tuple(r) for r in compiler.compile_plan(rows, validate(raw, fields), fields).collect()]


def eq(value, operator="eq", column="地区"):
    return [{"column": column, "operator": operator, "value": value}]


def test_group_and_sum(sales):
    assert run(sales, {"filters": eq("harbour"), "group_by": ["地区"], "metric": "sum", "metric_column": "金额"}) == [("harbour", 15.5, 2)]


def test_direct_children(sales):
    assert run(sales, {"filters": eq("all", "direct_child_of"), "metric": "sum", "metric_column": "金额"}) == [(29.5, 2)]


def test_hint_where_nothing_matches(sales):
    raw = {"filters": eq("all")}
    assert run(sales, raw) == []
    assert compiler.hints(validate(raw, FIELDS), FIELDS) == [{"column": "地区", "operator": "direct_child_of", "value": "all"}]


@pytest.mark.parametrize("operator, value, rows", [("contains", "k\\s", [7]), ("contains", "\\", [7]), ("starts_with", "back\\", [7]), ("ends_with", "\\slash", [7]), ("contains", "HARB", [1, 2, 4, 6])])
def test_text_filters_take_values_as_they_are(sales, operator, value, rows):
    assert [r[0] for r in run(sales, {"metric": "rows", "filters": eq(value, operator)})] == rows


@pytest.mark.parametrize("raw", [
    {"filters": eq("x", column="no")}, {"nope": 1}, {"filters": [{"column": "地区", "value": 1}]}, {"filters": eq(None, "gt")}, {"filters": eq([1], "eq")}, {"filters": eq("x", "like")},
    {"metric": "sum"}, {"metric": "rows", "group_by": ["地区"]}, {"limit": 0}, {"limit": 201}, {"limit": True}, {"offset": -1}, {"sort_by": "metric"}, {"metric": "count", "sort_by": "金额"},
    {"filters": eq("a") * 9}, {"metric": "count", "group_by": ["地区", "金额", "日期", "地区"]}, {"filters": eq(list(range(101)), "in")}, {"sort_order": "up"}, [], {"filters": eq([None], "in")},
])
def test_refused_plans(raw):
    with pytest.raises(PlanError) as error:
        validate(raw, FIELDS)
    assert error.value.code == "invalid_query"


@pytest.mark.parametrize("raw", [{"filters": eq("1", "contains", "金额")}, {"metric": "sum", "metric_column": "地区"}, {"filters": eq("x", "gt", "金额")}])
def test_plans_that_types_rule_out(sales, raw):
    with pytest.raises(PlanError) as error:
        run(sales, raw)
    assert error.value.code == "query_failed"


def test_drafted_plans():
    plan = validate_drafted({"limit": 0, "sort_by": None}, FIELDS)
    assert (plan.metric, plan.sort_order, plan.limit) == ("count", "desc", 20)
    assert validate_drafted({"limit": 99}, FIELDS).limit == 50
    assert plan.echo()["metric"] == "count"


def test_purchase_sheet(spark):
    fields = [Field("kind"), Field("paid", "number"), Field("share", "number")]
    rows = [(11, "lamps", "￥3,050元", "12%（原始值：0.125）"), (12, "ropes", "90", "80%"), (13, "lamps", "50", None), (14, "ropes", "later", "40%（原始值：0.4）")]
    frame = spark.createDataFrame(rows, "row_number long, kind string, paid string, share string")
    lamps = {"filters": eq("lamps", column="kind"), "group_by": ["kind"], "metric": "sum", "metric_column": "paid"}
    assert run(frame, lamps, fields) == [("lamps", 3100.0, 2)]
    stats = compiler.matched_stats(frame, validate(lamps, fields), fields).first()
    assert tuple(stats) == (2, 11, 13)
    assert [(k, round(x, 6), n) for k, x, n in run(frame, {"group_by": ["kind"], "metric": "avg", "metric_column": "share", "sort_order": "desc"}, fields)] == [("ropes", 0.6, 2), ("lamps", 0.125, 2)]
    assert compiler.invalid_numbers(frame, validate({"metric": "sum", "metric_column": "paid"}, fields), fields).first()["invalid"] == 1


@pytest.mark.parametrize("cells, metric, groups, want", [
    # the rule of each verdict (fixed values), on units of our own
    ([" box", "box ", "box"], "sum", [], "known"), (["mile", "yard"], "sum", [], "blocked"), (["mile", None, "mile"], "avg", [], "blocked"), (["", "yard"], "max", [], "blocked"), (["", None], "min", [], "unknown"),
    (["mile", "yard"], "sum", ["单位"], "grouped"), (["yard", None], "sum", ["单位"], "grouped"), (["mile", "yard"], "count", [], "not_applicable"), (["long" * 20] * 2, "sum", [], "unknown"),
])
def test_unit_verdicts(spark, cells, metric, groups, want):
    fields = [Field("值", "number"), Field("单位")]
    frame = spark.createDataFrame([(k, str(k + 2), u) for k, u in enumerate(cells)], "row_number long, `值` string, `单位` string")
    plan = Plan(metric=metric, metric_column="值", group_by=tuple(groups))
    columns = units.unit_columns(["值", "单位"])
    stats = [units.UnitStats(r["unit_column"], r["n_units"], r["n_blank"], tuple(r["units"].split("|"))) for r in compiler.unit_stats(frame, plan, fields, columns).collect()]
    assert units.verdict(plan, len(cells), columns, stats) == want


def test_coverage_and_withholding():
    assert units.covers([3, 2], 5) and not units.covers([3], 5)
    assert units.withheld("blocked", [1], 5) == {"rows": [], "matched_rows": 5, "warnings": ["units differ; the measure is withheld"]}
    assert units.withheld("known", [1], 5)["rows"] == [1]
    assert units.verdict(Plan(metric="sum"), 5, list("abcde"), []) == "blocked"


def test_filters_reach_the_scan(spark):
    from lodestone.operators import registry

    plan = registry.queries()["plan_sum_by_group"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity)" in plan and "l_comment" not in plan
    assert "ReadSchema: struct<l_quantity:double,l_extendedprice:double,l_returnflag:string,l_linestatus:string>" in plan
