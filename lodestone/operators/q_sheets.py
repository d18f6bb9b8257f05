"""Queries of sheets: a sheet for each nation, whose customers stand in blocks of seven rows, with and without headers, with summary rows, single cells, a column apart, merged cells and formulas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.catalog import table
from lodestone.operators import sheets
from lodestone.operators.registry import query

#: Places of a customer's cells, the same words in Spark and DuckDB: k is the nation, j the place among its customers (from 0).
ROW = "CAST(floor(j / 7) AS BIGINT) * 9 + 2 + j % 7"
APART = "CASE WHEN k % 5 = 1 THEN 5 ELSE 3 END"
BALANCE = "CASE WHEN j % 11 = 4 THEN '=B2' ELSE CAST(CAST(round(c_acctbal) AS BIGINT) AS {text}) END"
CELLS = [
    ("1", "CASE WHEN k % 5 = 0 AND j % 14 = 6 THEN 'Total' ELSE c_name END", "true"), ("2", BALANCE, "NOT (k % 5 = 2 AND j % 14 = 3)"), (APART, "c_mktsegment", "NOT (k % 5 = 2 AND j % 14 = 3)"),
]
#: Header rows stand above every other block.
HEADERS = [("1", "name"), ("2", "amount"), (APART, "segment")]
HEADED = "j % 7 = 0 AND (k + CAST(floor(j / 7) AS BIGINT)) % 2 = 0"


def cells(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Cells and merged ranges."""
    rows = table(spark, sf, "customer").withColumns({"k": F.col("c_nationkey"), "j": F.expr("row_number() over (partition by c_nationkey order by c_custkey) - 1")})
    own = [F.expr(f"CASE WHEN {when} THEN named_struct('row_number', {ROW}, 'column_number', {column}, 'cell', {cell.format(text='STRING')}) END") for column, cell, when in CELLS]
    own += [F.expr(f"CASE WHEN {HEADED} THEN named_struct('row_number', {ROW} - 1, 'column_number', {column}, 'cell', '{name}') END") for column, name in HEADERS]
    found = rows.select(F.col("k").alias("sheet"), F.explode(F.array_compact(F.array(*own))).alias("c")).select("sheet", "c.*")
    merged = table(spark, sf, "nation").where("n_nationkey % 5 = 3").select(F.col("n_nationkey").alias("sheet"), F.lit(2).alias("r1"), F.lit(1).alias("c1"), F.lit(3).alias("r2"), F.lit(1).alias("c2"))
    return found, merged


SHEETS = "WITH c0 AS (SELECT *, c_nationkey AS k, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS j FROM customer), cells AS (" + " UNION ALL ".join(
    [f"SELECT k AS sheet, {ROW} AS r, {column} AS c, {cell.format(text='VARCHAR')} AS cell FROM c0 WHERE {when}" for column, cell, when in CELLS] + [f"SELECT k, {ROW} - 1, {column}, '{name}' FROM c0 WHERE {HEADED}" for column, name in HEADERS]
) + r"""), rr AS (SELECT sheet, r, list(c ORDER BY c) AS cs, list(cell ORDER BY c) AS ts FROM cells WHERE trim(cell) <> '' GROUP BY 1, 2),
nr AS (SELECT *, CASE WHEN r = lag(r) OVER (PARTITION BY sheet ORDER BY r) + 1 THEN 0 ELSE 1 END AS new FROM rr), ir AS (SELECT *, sum(new) OVER (PARTITION BY sheet ORDER BY r) AS region FROM nr),
pr AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY sheet, region ORDER BY r) AS n FROM ir),
ag AS (SELECT sheet, region, min(r) AS row_start, max(r) AS row_end, count(*) AS n_rows, list_sort(list_distinct(flatten(list(cs)))) AS used, bool_or(len(cs) = 1) AS single, bool_or(n > 1 AND lower(ts[1]) IN ('total', 'subtotal', 'grand total')) AS summary, max(CASE WHEN n = 1 THEN cs END) AS c1, max(CASE WHEN n = 1 THEN ts END) AS t1, max(CASE WHEN n = 2 THEN ts END) AS t2 FROM pr GROUP BY 1, 2),
hd AS (SELECT *, coalesce(t2 IS NOT NULL AND len(t1) >= 2 AND len(list_distinct(t1)) = len(t1) AND len(list_filter(t1, lambda t: length(t) > 40 OR starts_with(t, '=') OR regexp_matches(t, '^[+-]?(\d+(\.\d*)?|\.\d+)$'))) = 0
  AND (len(list_filter(t1, lambda t: regexp_matches(t, '(?i)(id|name|date|time|amount|price|count|status|type|total|description)$'))) > 0 OR (len(list_filter(t2, lambda t: regexp_matches(t, '^[+-]?(\d+(\.\d*)?|\.\d+)$'))) > 0 AND len(list_filter(t1, lambda t: length(t) > 24)) = 0)), false) AS headed FROM ag),
rk AS (SELECT *, list_filter([CASE WHEN sheet % 5 = 3 AND row_start <= 3 AND row_end >= 2 AND used[1] <= 1 THEN 'merged_cells' END, CASE WHEN len(used) < used[-1] - used[1] + 1 THEN 'separated_columns' END, CASE WHEN len(used) > 1 AND single THEN 'mixed_single_cell_rows' END, CASE WHEN summary THEN 'summary_rows' END, CASE WHEN NOT headed THEN 'unconfirmed_header' END], lambda x: x IS NOT NULL) AS risks FROM hd),
rg AS MATERIALIZED (SELECT sheet, region, row_start, row_end, n_rows, CASE WHEN len(risks) = 0 THEN row_start END AS header_row, list_transform(range(1, used[-1] + 1), lambda x: coalesce(CASE WHEN len(risks) = 0 THEN t1[list_position(c1, x)] END, chr(CAST(64 + x AS INT)) || '列')) AS names, risks FROM rk)
"""


@query("sheet_regions", SHEETS + "SELECT sheet, CAST(region AS BIGINT) AS region, row_start, row_end, n_rows, header_row, array_to_string(names, ',') AS columns FROM rg")
def sheet_regions(spark: SparkSession, sf: str) -> DataFrame:
    own, merged = cells(spark, sf)
    return sheets.regions(sheets.region_rows(own), merged).select("sheet", "region", "row_start", "row_end", "n_rows", "header_row", F.array_join("columns", ",").alias("columns"))


@query("sheet_layout_risks", SHEETS + "SELECT sheet, CAST(region AS BIGINT) AS region, array_to_string(risks, ',') AS risks, len(risks) = 0 AS eligible FROM rg")
def sheet_layout_risks(spark: SparkSession, sf: str) -> DataFrame:
    own, merged = cells(spark, sf)
    return sheets.regions(sheets.region_rows(own), merged).select("sheet", "region", F.array_join("risks", ",").alias("risks"), "eligible")


@query("sheet_rows", SHEETS + """, x AS (SELECT sheet, region, r, unnest(cs) AS c, unnest(ts) AS t FROM pr)
SELECT x.sheet, CAST(x.region AS BIGINT) AS region, r AS row_number, '行 ' || r || '｜' || string_agg(names[c] || '=' || CASE WHEN starts_with(t, '=') THEN '公式' ELSE '' END || t, '｜' ORDER BY c) AS line FROM x JOIN rg ON rg.sheet = x.sheet AND rg.region = x.region WHERE r IS DISTINCT FROM header_row GROUP BY 1, 2, 3""")
def sheet_rows(spark: SparkSession, sf: str) -> DataFrame:
    own, merged = cells(spark, sf)
    rows = sheets.region_rows(own)
    return sheets.row_lines(rows, sheets.regions(rows, merged))
