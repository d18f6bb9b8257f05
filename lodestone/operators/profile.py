"""Column profiles, literals mentioned in a question, and table text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import typed

#: Names that say what a column is for, first match wins (fixed values).
ROLES = [
    ("time", r"(日期|时间|年份|月份|date|time|year|month|day)"),
    ("identifier", r"(编号|编码|代码|单号|身份证|手机|电话|(^|_)(id|code|no|key|sku|phone)$|key$)"),
    ("measure", r"(金额|数量|价格|单价|总额|成本|amount|price|total|quantity|qty|cost|rate|acctbal|discount|tax)"),
    ("status", r"(状态|status|state|flag)"),
    ("category", r"(类别|类型|分类|品类|部门|地区|category|type|kind|segment|region|brand|priority)"),
]
SHARE = 0.9


def unpivot(rows: DataFrame, columns: list[str]) -> DataFrame:
    """name, position and cell text of each column of each row; row_number is kept."""
    cells = F.array(*[F.struct(F.lit(c).alias("name"), F.lit(i).alias("place"), F.col(f"`{c}`").cast("string").alias("cell")) for i, c in enumerate(columns)])
    return rows.select("row_number", F.explode(cells).alias("x")).select("row_number", "x.*")


def semantic_role(name: Column) -> Column:
    found = reduce(lambda acc, r: acc.when(F.lower(name).rlike(r[1]), r[0]), ROLES[1:], F.when(F.lower(name).rlike(ROLES[0][1]), ROLES[0][0]))
    return found


def infer_type(role: Column, filled: Column, numbers: Column, dates: Column, booleans: Column) -> Column:
    """identifier by name, then date, boolean and number by a share of the filled cells, else text."""
    enough = F.greatest(F.lit(1), F.floor(filled * SHARE))
    return (
        F.when(role == "identifier", "identifier").when((role == "time") & (dates < enough), "text")
        .when(dates >= enough, "date").when(booleans >= enough, "boolean").when(numbers >= enough, "number").otherwise("text")
    )


def profile_fields(rows: DataFrame, columns: list[str], cap: int = 500) -> DataFrame:
    """One pass over all columns, combined before its one small shuffle; the exact distinct count is null above the cap."""
    cell = F.col("cell")
    filled = cell.isNotNull() & (cell != "")
    count = lambda c: F.sum(c.cast("long"))
    number = F.when(filled, typed.number(cell))
    long = unpivot(rows, columns)
    stats = long.groupBy("name").agg(
        F.count(F.lit(1)).alias("n_rows"), count(~F.coalesce(filled, F.lit(False))).alias("n_null"), count(F.coalesce(filled, F.lit(False))).alias("n_filled"),
        count(number.isNotNull()).alias("n_number"), count(F.when(filled, typed.calendar_date(cell)).isNotNull()).alias("n_date"),
        count(F.coalesce(filled & typed.is_boolean(cell), F.lit(False))).alias("n_boolean"), F.min(number).alias("least"), F.max(number).alias("greatest"), F.count_distinct(F.when(filled, cell)).alias("n_distinct"),
    )
    role = semantic_role(F.col("name"))
    kind = infer_type(F.coalesce(role, F.lit("")), F.col("n_filled"), F.col("n_number"), F.col("n_date"), F.col("n_boolean"))
    best = F.greatest("n_number", "n_date", "n_boolean")
    return stats.select(
        "name", "n_null", "n_filled", "n_number", "n_date", "n_boolean", F.when(F.col("n_distinct") <= cap, F.col("n_distinct")).alias("n_distinct"), (F.col("n_distinct") > cap).alias("capped"),
        "least", "greatest", role.alias("role"), kind.alias("kind"), F.when(F.col("n_filled") > 0, F.round(best / F.col("n_filled"), 3)).otherwise(0.0).alias("confidence"),
    )


def samples(rows: DataFrame, columns: list[str], most: int = 8) -> DataFrame:
    """The first distinct values of each column in row order; only the least row of each value is shuffled on."""
    long = unpivot(rows, columns).where("cell is not null and cell <> ''")
    first = long.groupBy("name", "cell").agg(F.min("row_number").alias("row"))
    # the group limit is applied before the shuffle by name too, so a task gives most rows of a column at most
    first = first.withColumn("place", F.row_number().over(Window.partitionBy("name").orderBy("row", "cell"))).where(F.col("place") <= most)
    return first.groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "cell"))), lambda x: x["cell"]), "|").alias("samples"))


def dataset_quality(rows: DataFrame, columns: list[str]) -> DataFrame:
    empty = F.col("cell").isNull() | (F.col("cell") == "")
    out = unpivot(rows, columns).agg(F.count(F.lit(1)).alias("cells"), F.coalesce(F.sum(empty.cast("long")), F.lit(0)).alias("empty"))
    return out.withColumn("completeness", F.when(F.col("cells") == 0, 1.0).otherwise(F.round(1 - F.col("empty") / F.col("cells"), 4)))


def mentioned_values(rows: DataFrame, columns: list[str], question: str, least: int = 2, longest: int = 80) -> DataFrame:
    """The longest value of each column that a question mentions."""
    long = unpivot(rows, columns).select("name", "cell").where(F.length("cell").between(least, longest))
    hits = long.where(F.contains(F.lit(question.lower()), F.lower("cell"))).distinct()
    return hits.groupBy("name").agg(F.max(F.struct(F.length("cell").alias("n"), "cell")).alias("m")).select("name", F.col("m.cell").alias("value"))


#: A day or month written out, and what binds a value to a column in a question (fixed values).
DATE = r"\d{4}[-/.年]\d{1,2}([-/.月]\d{1,2}日?|月)|\d{1,2}月\d{1,2}日"
BINDS, ENDS = r"(?:为|是|等于|属于|：|:|=)\s*", r"(?:\s|的|、|，|。|？|\?|$)"


def literals_suffice(question: Column, values: Column) -> Column:
    """Whether the values found in a question express all its conditions: two of them do, one does if the question binds it (as in status: open),
    and a date in the question must be among them."""
    dated = F.exists(values, lambda v: v.rlike(f"^({DATE})$"))
    bound = lambda v: F.rlike(question, F.concat(F.lit("(?iu)" + BINDS + r"\Q"), F.replace(v, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E" + ENDS)))
    return F.coalesce(
        F.when(F.size(values) < 1, False).when(question.rlike(DATE) & ~dated, False).when(F.size(values) >= 2, True).otherwise(bound(F.try_element_at(values, F.lit(1)))), F.lit(False)
    )


def date_aliases(day: Column) -> Column:
    """Ways to write a day, for finding it in a question."""
    return F.array(*[F.date_format(day, f) for f in ("yyyy-MM-dd", "yyyy/MM/dd", "yyyy/M/d", "yyyy.M.d", "yyyy年M月d日", "yyyy年MM月dd日", "M月d日", "M/d")])


def table_rows(lines: Column) -> Column:
    """row_number and values of lines such as 行 3｜name=value｜..."""
    parts = F.split(F.regexp_extract(lines, r"^行 \d+｜(.*)$", 1), "｜")
    return F.struct(F.regexp_extract(lines, r"^行 (\d+)｜", 1).try_cast("long").alias("row_number"), F.map_from_arrays(F.transform(parts, lambda p: F.substring_index(p, "=", 1)), F.transform(parts, lambda p: F.regexp_extract(p, r"^[^=]*=(.*)$", 1))).alias("values"))
