"""Queries over the dataset plan: one per filter operator, metric, ordering and statistic.

The dataset is made of customers with their region path, with amounts written in the ways people write them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.catalog import table, tables
from lodestone.functions import typed
from lodestone.operators.registry import query
from lodestone.plans import compiler
from lodestone.plans.model import Field, Plan, validate

FIELDS = [Field("path"), Field("segment"), Field("amount", "number"), Field("day", "date"), Field("code", "identifier")]

DATASET = r"""
WITH base AS (SELECT c_custkey AS row_number, r_name || '-' || n_name || CASE WHEN c_custkey % 3 = 0 THEN '-' || c_name ELSE '' END AS path,
  CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN '' ELSE c_mktsegment END AS segment,
  CAST(CAST(round(c_acctbal * 100) AS BIGINT) AS VARCHAR) AS cents, c_custkey AS k
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
data AS (SELECT row_number, path, segment,
  CASE k % 6 WHEN 0 THEN '￥' || cents WHEN 1 THEN cents || '元' WHEN 2 THEN cents || '%' WHEN 3 THEN 'about（原始值：' || cents || '）' WHEN 4 THEN ' ' || cents || ' ' ELSE 'n/a' END AS amount,
  CASE WHEN k % 10 = 0 THEN '2024/' || CAST(k % 12 + 1 AS VARCHAR) || '/' || CAST(k % 28 + 1 AS VARCHAR) WHEN k % 13 = 0 THEN 'soon'
    ELSE '2024-' || lpad(CAST(k % 12 + 1 AS VARCHAR), 2, '0') || '-' || lpad(CAST(k % 28 + 1 AS VARCHAR), 2, '0') END AS day,
  lpad(CAST(k AS VARCHAR), 6, '0') AS code FROM base),
typed AS (SELECT *, CASE WHEN regexp_matches(amount, '（原始值：([^）]*)）$') THEN try_cast(regexp_extract(amount, '（原始值：([^）]*)）$', 1) AS DOUBLE)
  WHEN ends_with(trim(amount), '%') THEN try_cast(regexp_replace(amount, '[,，\s￥¥$元%]', '', 'g') AS DOUBLE) / 100.0
  ELSE try_cast(regexp_replace(amount, '[,，\s￥¥$元%]', '', 'g') AS DOUBLE) END AS num, try_cast(day AS DATE) AS d FROM data)
"""


def dataset(spark: SparkSession, sf: str) -> DataFrame:
    customer, nation, region = tables(spark, sf, "customer", "nation", "region")
    k, n = F.col("c_custkey"), lambda c: c.cast("string")
    rows = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    cents = n(F.round(F.col("c_acctbal") * 100).cast("long"))
    month, dom = k % 12 + 1, k % 28 + 1
    return rows.select(
        k.alias("row_number"),
        F.concat("r_name", F.lit("-"), "n_name", F.when(k % 3 == 0, F.concat(F.lit("-"), "c_name")).otherwise("")).alias("path"),
        F.when(k % 7 == 0, None).when(k % 11 == 0, "").otherwise(F.col("c_mktsegment")).alias("segment"),
        F.when(k % 6 == 0, F.concat(F.lit("￥"), cents)).when(k % 6 == 1, F.concat(cents, F.lit("元"))).when(k % 6 == 2, F.concat(cents, F.lit("%")))
        .when(k % 6 == 3, F.concat(F.lit("about（原始值："), cents, F.lit("）"))).when(k % 6 == 4, F.concat(F.lit(" "), cents, F.lit(" "))).otherwise("n/a").alias("amount"),
        F.when(k % 10 == 0, F.concat(F.lit("2024/"), n(month), F.lit("/"), n(dom))).when(k % 13 == 0, "soon")
        .otherwise(F.concat(F.lit("2024-"), F.lpad(n(month), 2, "0"), F.lit("-"), F.lpad(n(dom), 2, "0"))).alias("day"),
        F.lpad(n(k), 6, "0").alias("code"),
    )


def plan_query(name: str, raw: dict, sql: str) -> None:
    plan = validate(raw, FIELDS)
    query(name, DATASET + sql)(lambda spark, sf: compiler.compile_plan(dataset(spark, sf), plan, FIELDS))


def _rows(where: str, columns: str = "row_number, path, amount", order: str = "row_number", limit: int = 200, offset: int = 0) -> str:
    return f"SELECT {columns} FROM typed WHERE {where} ORDER BY {order} LIMIT {limit} OFFSET {offset}"


def _f(column: str, operator: str, value: object) -> dict:
    return {"metric": "rows", "columns": ["path", "amount"], "limit": 200, "filters": [{"column": column, "operator": operator, "value": value}]}


FILTERS = [
    ("filter_eq_text", "segment", "eq", "BUILDING", "segment = 'BUILDING'"),
    ("filter_eq_number", "amount", "eq", 0, "num = 0"),
    ("filter_eq_null", "segment", "eq", None, "segment IS NULL"),
    ("filter_ne_text", "segment", "ne", "BUILDING", "segment <> 'BUILDING'"),
    ("filter_ne_null", "segment", "ne", None, "segment IS NOT NULL"),
    ("filter_gt", "amount", "gt", 500000, "num > 500000"),
    ("filter_gte", "day", "gte", "2024-10-01", "d >= DATE '2024-10-01'"),
    ("filter_lt", "amount", "lt", "100", "num < 100"),
    ("filter_lte_text", "code", "lte", "000050", "code <= '000050'"),
    ("filter_contains", "path", "contains", "n_1_", "coalesce(path, '') ILIKE '%n_1_%'"),
    ("filter_contains_wildcard", "code", "contains", "0_1%5", "coalesce(code, '') ILIKE '%0_1%5%'"),
    ("filter_starts_with", "path", "starts_with", "asia-nation_2", "coalesce(path, '') ILIKE 'asia-nation_2%'"),
    ("filter_ends_with", "code", "ends_with", "77", "coalesce(code, '') ILIKE '%77'"),
    ("filter_direct_child_of", "path", "direct_child_of", "ASIA", "regexp_matches(path, '(^|[-/＞>])ASIA[-/＞>][^-/＞>]+$')"),
    ("filter_in", "segment", "in", ["BUILDING", "MACHINERY", ""], "segment IN ('BUILDING', 'MACHINERY', '')"),
    ("filter_in_number", "amount", "in", [100, "250.5", 3], "num IN (100, 250.5, 3)"),
    ("filter_in_empty", "segment", "in", [], "false"),
]
for name, column, operator, value, where in FILTERS:
    plan_query(name, _f(column, operator, value), _rows(where))

plan_query("filter_conjunction", {"limit": 200, "columns": ["path", "amount"], "filters": [{"column": "segment", "op": "ne", "value": "BUILDING"}, {"column": "amount", "op": "gte", "value": 1000}, {"column": "path", "op": "starts_with", "value": "EUROPE"}]}, _rows("segment <> 'BUILDING' AND num >= 1000 AND path ILIKE 'EUROPE%'"))
plan_query("project_rows", {"limit": 30}, _rows("true", "row_number, path, segment, amount, day, code", limit=30))
plan_query("sort_rows_text_asc", {"columns": ["segment", "amount"], "sort_by": "segment", "limit": 120, "offset": 40}, _rows("true", "row_number, segment, amount", "segment ASC NULLS LAST, row_number", 120, 40))
plan_query("sort_rows_text_desc", {"columns": ["amount"], "sort_by": "amount", "sort_order": "desc", "limit": 60}, _rows("true", "row_number, amount", "amount DESC NULLS LAST, row_number", 60))
plan_query("limit_offset", {"columns": ["code"], "limit": 7, "offset": 11}, _rows("true", "row_number, code", limit=7, offset=11))
plan_query("preview", {"limit": 200}, _rows("true", "row_number, path, segment, amount, day, code"))


def _agg(name: str, metric: str, column: str | None, expression: str, **more: object) -> None:
    groups = more.get("group_by", ["segment"])
    raw = {"metric": metric, "group_by": groups, "limit": 200, "sort_by": "metric", "sort_order": "desc"} | ({"metric_column": column} if column else {}) | more
    by = ", ".join(groups)
    plan_query(name, raw, f"SELECT {by + ', ' if by else ''}{expression} AS metric, count(*) AS matched_rows FROM typed {'GROUP BY ' + by if by else ''} ORDER BY metric {raw['sort_order']} NULLS LAST{', ' + by if by else ''} LIMIT {raw['limit']}")


_agg("agg_count", "count", None, "count(*)")
_agg("agg_count_distinct", "count_distinct", "segment", "count(DISTINCT segment)", group_by=["day"], limit=40)
_agg("agg_sum", "sum", "amount", "sum(num)")
_agg("agg_avg", "avg", "amount", "avg(num)")
_agg("agg_min_number", "min", "amount", "min(num)")
_agg("agg_max_date", "max", "day", "max(d)")
_agg("agg_min_text", "min", "path", "min(path)")
_agg("agg_global", "sum", "amount", "sum(num)", group_by=[])
_agg("group_by_two", "sum", "amount", "sum(num)", group_by=["segment", "day"], limit=50)
_agg("top_k", "count", None, "count(*)", group_by=["path"], limit=5)


@query("agg_empty_input", DATASET + "SELECT sum(num) AS metric, count(*) AS matched_rows FROM typed WHERE false")
def agg_empty_input(spark: SparkSession, sf: str) -> DataFrame:
    plan = validate({"metric": "sum", "metric_column": "amount", "filters": [{"column": "segment", "op": "in", "value": []}]}, FIELDS)
    return compiler.compile_plan(dataset(spark, sf), plan, FIELDS)


PLAN_GT = validate({"metric": "sum", "metric_column": "amount", "filters": [{"column": "amount", "op": "gt", "value": 1000}]}, FIELDS)


@query("matched_stats", DATASET + "SELECT count(*) AS matched, min(row_number) AS first_row, max(row_number) AS last_row FROM typed WHERE num > 1000")
def matched_stats(spark: SparkSession, sf: str) -> DataFrame:
    return compiler.matched_stats(dataset(spark, sf), PLAN_GT, FIELDS)


@query("row_provenance", DATASET + "SELECT row_number FROM typed WHERE num > 1000 ORDER BY row_number LIMIT 200")
def row_provenance(spark: SparkSession, sf: str) -> DataFrame:
    return compiler.provenance(dataset(spark, sf), PLAN_GT, FIELDS)


@query("measure_context_stats", DATASET + """, long AS (SELECT 'segment' AS unit_column, coalesce(trim(segment), '') AS unit FROM typed WHERE num > 1000)
SELECT unit_column, count(DISTINCT nullif(unit, '')) AS n_units, CAST(sum(CASE WHEN unit = '' THEN 1 ELSE 0 END) AS BIGINT) AS n_blank,
array_to_string(list_slice(list_sort(list(DISTINCT unit) FILTER (WHERE unit <> '')), 1, 5), '|') AS units FROM long GROUP BY 1""")
def measure_context_stats(spark: SparkSession, sf: str) -> DataFrame:
    return compiler.unit_stats(dataset(spark, sf), PLAN_GT, FIELDS, ["segment"])


@query("invalid_number_warning", DATASET + "SELECT CAST(sum(CASE WHEN amount IS NOT NULL AND num IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS invalid FROM typed")
def invalid_number_warning(spark: SparkSession, sf: str) -> DataFrame:
    return compiler.invalid_numbers(dataset(spark, sf), Plan(metric="sum", metric_column="amount"), FIELDS)


@query("group_coverage", DATASET + """, g AS (SELECT segment, count(*) AS n FROM typed GROUP BY 1), s AS (SELECT *, sum(n) OVER () AS matched FROM g),
page AS (SELECT * FROM s ORDER BY n DESC, segment NULLS LAST LIMIT 3)
SELECT CAST(sum(n) AS BIGINT) AS shown, CAST(max(matched) AS BIGINT) AS matched, sum(n) >= max(matched) AS covered FROM page""")
def group_coverage(spark: SparkSession, sf: str) -> DataFrame:
    groups = dataset(spark, sf).groupBy("segment").agg(F.count(F.lit(1)).alias("n"))
    total = groups.agg(F.sum("n").alias("matched"))
    page = groups.orderBy(F.desc("n"), F.col("segment").asc_nulls_last()).limit(3).agg(F.sum("n").alias("shown"))
    return page.join(total, F.lit(True)).select("shown", "matched", (F.col("shown") >= F.col("matched")).alias("covered"))


@query("evidence_rows", DATASET + "SELECT row_number, path, code FROM typed WHERE row_number IN (3, 5, 8, 13, 21, 99999999)")
def evidence_rows(spark: SparkSession, sf: str) -> DataFrame:
    wanted = spark.createDataFrame([(k,) for k in (3, 5, 8, 13, 21, 99_999_999)], "row_number long")
    return dataset(spark, sf).join(F.broadcast(wanted), "row_number", "left_semi").select("row_number", "path", "code")


@query("typed_expression", DATASET + "SELECT row_number, num, d FROM typed")
def typed_expression(spark: SparkSession, sf: str) -> DataFrame:
    return dataset(spark, sf).select("row_number", typed.number(F.col("amount")).alias("num"), typed.date(F.col("day")).alias("d"))


@query("row_compat_sum", DATASET + r""", e AS (SELECT lower(coalesce(segment, '')) AS seg, CAST(round(num, 2) AS DECIMAL(38,2)) AS x FROM typed)
SELECT seg, CAST(sum(x) AS DOUBLE) AS metric, count(*) AS matched_rows, CAST(sum(CASE WHEN x IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS invalid FROM e GROUP BY 1""")
def row_compat_sum(spark: SparkSession, sf: str) -> DataFrame:
    """The compatible executor: case-folded text, exact decimal sums, a count of invalid numbers."""
    x = typed.exact_number(F.col("amount")).cast("decimal(38,2)")
    rows = dataset(spark, sf).select(F.lower(F.coalesce("segment", F.lit(""))).alias("seg"), x.alias("x"))
    return rows.groupBy("seg").agg(F.sum("x").cast("double").alias("metric"), F.count(F.lit(1)).alias("matched_rows"), F.sum(F.col("x").isNull().cast("long")).alias("invalid"))


@query("safe_sort_value", DATASET + """SELECT row_number, amount FROM typed ORDER BY CASE WHEN amount IS NULL THEN 0 WHEN num IS NULL THEN 1 ELSE 2 END, num, lower(amount), row_number LIMIT 100""")
def safe_sort_value(spark: SparkSession, sf: str) -> DataFrame:
    num = typed.number(F.col("amount"))
    kind = F.when(F.col("amount").isNull(), 0).when(num.isNull(), 1).otherwise(2)
    return dataset(spark, sf).orderBy(kind, num, F.lower("amount"), "row_number").select("row_number", "amount").limit(100)


@query("plan_sum_by_group", """
SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice), 2) AS metric, count(*) AS matched_rows
FROM lineitem WHERE l_quantity >= 25 AND l_returnflag IN ('A', 'R') GROUP BY 1, 2""")
def plan_sum_by_group(spark: SparkSession, sf: str) -> DataFrame:
    fields = [Field("l_quantity", "number"), Field("l_returnflag"), Field("l_linestatus"), Field("l_extendedprice", "number")]
    raw = {"filters": [{"column": "l_quantity", "operator": "gte", "value": 25}, {"column": "l_returnflag", "operator": "in", "value": ["A", "R"]}], "group_by": ["l_returnflag", "l_linestatus"], "metric": "sum", "metric_column": "l_extendedprice", "sort_by": "metric", "sort_order": "desc"}
    plan = validate(raw, fields)
    # these columns are numbers already: the plan runs on them as they are, so its filters reach the scan
    rows = table(spark, sf, "lineitem").where(F.col("l_quantity") >= float(plan.filters[0].value)).where(compiler.predicate(plan.filters[1], "text"))
    return rows.groupBy(*plan.group_by).agg(F.round(F.sum(plan.metric_column), 2).alias("metric"), F.count(F.lit(1)).alias("matched_rows"))
