"""Queries of column profiling and literal discovery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.catalog import table
from lodestone.functions import typed
from lodestone.operators import profile
from lodestone.operators.q_plan import DATASET, dataset
from lodestone.operators.ranks import global_rank
from lodestone.operators.registry import query

COLUMNS = ["path", "segment", "amount", "day", "code"]
LONG = DATASET + ", long AS (" + " UNION ALL ".join(f"SELECT row_number, '{c}' AS name, {c} AS cell FROM data" for c in COLUMNS) + r"""),
cells AS (SELECT *, cell IS NOT NULL AND cell <> '' AS filled,
  CASE WHEN regexp_matches(cell, '（原始值：([^）]*)）$') THEN try_cast(regexp_extract(cell, '（原始值：([^）]*)）$', 1) AS DOUBLE)
  WHEN ends_with(trim(cell), '%') THEN try_cast(regexp_replace(cell, '[,，\s￥¥$元%]', '', 'g') AS DOUBLE) / 100.0
  ELSE try_cast(regexp_replace(cell, '[,，\s￥¥$元%]', '', 'g') AS DOUBLE) END AS num,
  try_cast(CASE WHEN regexp_matches(cell, '^\s*\d{4}[-/.年]\d{1,2}[-/.月]\d{1,2}日?\s*$') THEN regexp_extract(cell, '^\s*(\d{4})', 1) || '-' || lpad(regexp_extract(cell, '^\s*\d{4}[-/.年](\d{1,2})', 1), 2, '0') || '-' || lpad(regexp_extract(cell, '(\d{1,2})日?\s*$', 1), 2, '0') END AS DATE) AS cal FROM long)
"""
ROLE = """CASE WHEN name = 'day' THEN 'time' WHEN name = 'code' THEN 'identifier' WHEN name = 'amount' THEN 'measure' WHEN name = 'segment' THEN 'category' END"""


@query("profile_fields", LONG + f""", s AS (SELECT name, count(*) - count(*) FILTER (WHERE filled) AS n_null, count(*) FILTER (WHERE filled) AS n_filled, count(num) FILTER (WHERE filled) AS n_number,
  count(cal) FILTER (WHERE filled) AS n_date, 0 AS n_boolean, min(num) AS least, max(num) AS greatest, count(DISTINCT CASE WHEN filled THEN cell END) AS n FROM cells GROUP BY 1)
SELECT name, n_null, n_filled, n_number, n_date, CAST(n_boolean AS BIGINT) AS n_boolean, CASE WHEN n <= 500 THEN n END AS n_distinct, n > 500 AS capped, least, greatest, {ROLE} AS role,
CASE WHEN name = 'code' THEN 'identifier' WHEN n_date >= greatest(1, floor(n_filled * 0.9)) THEN 'date' WHEN name = 'day' THEN 'text' WHEN n_number >= greatest(1, floor(n_filled * 0.9)) THEN 'number' ELSE 'text' END AS kind,
round(greatest(n_number, n_date, n_boolean) / n_filled, 3) AS confidence FROM s""")
def profile_fields(spark: SparkSession, sf: str) -> DataFrame:
    return profile.profile_fields(dataset(spark, sf), COLUMNS)


@query("profile_samples", LONG + """, f AS (SELECT name, cell, min(row_number) AS r FROM cells WHERE filled GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY r, cell) AS n FROM f)
SELECT name, string_agg(cell, '|' ORDER BY n) AS samples FROM k WHERE n <= 8 GROUP BY 1""")
def profile_samples(spark: SparkSession, sf: str) -> DataFrame:
    return profile.samples(dataset(spark, sf), COLUMNS)


@query("dataset_quality", LONG + "SELECT count(*) AS cells, count(*) - count(*) FILTER (WHERE filled) AS empty, round(1 - (count(*) - count(*) FILTER (WHERE filled)) / count(*), 4) AS completeness FROM cells")
def dataset_quality(spark: SparkSession, sf: str) -> DataFrame:
    return profile.dataset_quality(dataset(spark, sf), COLUMNS)


QUESTION = "how much did asia-nation_2 and EUROPE-NATION_8 sell to BUILDING in 2024?"


@query("literal_discovery", LONG + f""", h AS (SELECT DISTINCT name, cell FROM long WHERE name IN ('path', 'segment') AND length(cell) BETWEEN 2 AND 80 AND contains('{QUESTION.lower()}', lower(cell))),
k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY length(cell) DESC, cell DESC) AS n FROM h) SELECT name, cell AS value FROM k WHERE n = 1""")
def literal_discovery(spark: SparkSession, sf: str) -> DataFrame:
    return profile.mentioned_values(dataset(spark, sf), ["path", "segment"], QUESTION)


@query("date_aliases", """SELECT DISTINCT d, unnest([strftime(d, '%Y-%m-%d'), strftime(d, '%Y/%m/%d'), strftime(d, '%Y/%-m/%-d'), strftime(d, '%Y.%-m.%-d'), strftime(d, '%Y年%-m月%-d日'), strftime(d, '%Y年%m月%d日'), strftime(d, '%-m月%-d日'), strftime(d, '%-m/%-d')]) AS alias
FROM (SELECT CAST(o_orderdate AS DATE) AS d FROM orders)""")
def date_aliases(spark: SparkSession, sf: str) -> DataFrame:
    days = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    return days.select("d", F.explode(profile.date_aliases(F.col("d"))).alias("alias")).distinct()


@query("date_parse", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(NULL AS DATE) AS none FROM orders")
def date_parse(spark: SparkSession, sf: str) -> DataFrame:
    d = F.date_format("o_orderdate", "yyyy年M月d日")
    return table(spark, sf, "orders").select("o_orderkey", typed.calendar_date(d).alias("d"), typed.calendar_date(F.regexp_replace(d, "月.*", "月32日")).alias("none"))


@query("numeric_parse", "SELECT c_custkey, round(CAST(CAST(round(c_acctbal * 100) AS BIGINT) AS DOUBLE) / 100, 6) AS share, CAST(CAST(round(c_acctbal * 100) AS BIGINT) AS DOUBLE) AS raw FROM customer")
def numeric_parse(spark: SparkSession, sf: str) -> DataFrame:
    cents = F.round(F.col("c_acctbal") * 100).cast("long").cast("string")
    return table(spark, sf, "customer").select("c_custkey", F.round(typed.exact_number(F.concat(cents, F.lit(" %"))).cast("double"), 6).alias("share"), typed.exact_number(F.concat(F.lit("some（原始值："), cents, F.lit("）"))).cast("double").alias("raw"))


@query("table_row_extract", "SELECT c_custkey AS row_number, c_name AS name, c_mktsegment AS segment FROM customer")
def table_row_extract(spark: SparkSession, sf: str) -> DataFrame:
    line = F.concat(F.lit("行 "), F.col("c_custkey").cast("string"), F.lit("｜name="), F.col("c_name"), F.lit("｜segment="), F.col("c_mktsegment"))
    rows = table(spark, sf, "customer").select(profile.table_rows(line).alias("r"))
    return rows.select("r.row_number", F.col("r.values")["name"].alias("name"), F.col("r.values")["segment"].alias("segment"))


@query("representative_rows", DATASET + ", n AS (SELECT *, row_number() OVER (ORDER BY row_number) - 1 AS i, count(*) OVER () AS n FROM data) SELECT row_number, code FROM n WHERE i IN (SELECT CAST(floor(k * (n - 1) / 11) AS BIGINT) FROM range(12) t(k), (SELECT max(n) AS n FROM n))")
def representative_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Twelve rows, evenly spaced by rank; the places come from one count, and only ranks are sorted."""
    rows = dataset(spark, sf)
    n = rows.count()
    wanted = sorted({k * (n - 1) // 11 for k in range(12)}) if n else []
    return global_rank(rows.select("row_number", "code"), "row_number").where(F.col("rank").isin(wanted)).select("row_number", "code")


@query("intent_classify", "SELECT count(*) FILTER (WHERE regexp_matches(lower(text), '(how many|combien|wie viele|count)')) AS counting, count(*) FILTER (WHERE regexp_matches(lower(text), '(sum|total|average|somme|moyenne)')) AS structured, count(*) AS n FROM conversations WHERE role = 'user'")
def intent_classify(spark: SparkSession, sf: str) -> DataFrame:
    said = F.lower("text")
    turns = table(spark, sf, "conversations").where("role = 'user'")
    return turns.agg(F.count_if(said.rlike("(how many|combien|wie viele|count)")).alias("counting"), F.count_if(said.rlike("(sum|total|average|somme|moyenne)")).alias("structured"), F.count(F.lit(1)).alias("n"))
