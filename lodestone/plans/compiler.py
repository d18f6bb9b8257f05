"""Compiles a validated plan to lazy DataFrames; Catalyst does the rest.

A dataset is a DataFrame with row_number (long) and one text column per field. Comparisons and measures see the typed view of
a column, grouping, sorting and counting distinct values the text itself. Nulls come last in either order, and ties
are broken by row_number or the group columns, so that a page is the same each time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.paths import is_direct_child
from lodestone.functions.typed import typed
from lodestone.plans.model import Field, Filter, Plan, PlanError

COMPARE = {"gt": "__gt__", "gte": "__ge__", "lt": "__lt__", "lte": "__le__"}


def _literal(value: object, kind: str) -> Column:
    if kind == "number":
        try:
            return F.lit(float(value))
        except (TypeError, ValueError):
            raise PlanError("query_failed", f"{value!r} is no number") from None
    return F.lit(str(value)).cast("date") if kind == "date" else F.lit(str(value))


def predicate(f: Filter, kind: str) -> Column:
    """Three-valued: a null cell fits no comparison, not even ne."""
    cell = typed(F.col(f"`{f.column}`"), kind)
    text_only = {"contains": "%{}%", "starts_with": "{}%", "ends_with": "%{}"}
    if f.operator in text_only:
        if kind in ("number", "date"):
            raise PlanError("query_failed", f"{f.operator} needs a text column")
        return F.coalesce(cell, F.lit("")).ilike(text_only[f.operator].format(str(f.value).replace("\\", "\\\\")))
    if f.operator == "direct_child_of":
        return is_direct_child(F.coalesce(F.col(f"`{f.column}`"), F.lit("")), str(f.value))
    if f.operator == "in":
        return cell.isin([_literal(v, kind) for v in f.value]) if f.value else F.lit(False)
    if f.value is None:
        return cell.isNull() if f.operator == "eq" else cell.isNotNull()
    value = _literal(f.value, kind)
    if f.operator in ("eq", "ne"):
        return cell == value if f.operator == "eq" else cell != value
    return getattr(cell, COMPARE[f.operator])(value)


def matched(rows: DataFrame, plan: Plan, fields: list[Field]) -> DataFrame:
    kinds = {f.name: f.kind for f in fields}
    conditions = [predicate(f, kinds[f.column]) for f in plan.filters]
    return rows.where(reduce(lambda a, b: a & b, conditions)) if conditions else rows


def _ordered(column: str, order: str) -> Column:
    return F.col(f"`{column}`").asc_nulls_last() if order == "asc" else F.col(f"`{column}`").desc_nulls_last()


def measure(plan: Plan, fields: list[Field]) -> Column:
    if plan.metric == "count":
        return F.count(F.lit(1))
    kind = {f.name: f.kind for f in fields}[plan.metric_column]
    text = F.col(f"`{plan.metric_column}`")
    if plan.metric == "count_distinct":
        return F.count_distinct(text)
    if plan.metric in ("sum", "avg") and kind != "number":
        raise PlanError("query_failed", f"{plan.metric} needs a number column")
    return getattr(F, plan.metric)(typed(text, kind))


def compile_plan(rows: DataFrame, plan: Plan, fields: list[Field]) -> DataFrame:
    """The page the plan asks for."""
    found = matched(rows, plan, fields)
    if plan.metric == "rows":
        shown = [f"`{c}`" for c in plan.columns or [f.name for f in fields]]
        order = [_ordered(plan.sort_by, plan.sort_order)] if plan.sort_by and plan.sort_by != "row_number" else []
        last = F.col("row_number").desc() if plan.sort_by == "row_number" and plan.sort_order == "desc" else F.col("row_number")
        return found.orderBy(*order, last).select("row_number", *shown).offset(plan.offset).limit(plan.limit)
    groups = [f"`{c}`" for c in plan.group_by]
    out = found.groupBy(*groups).agg(measure(plan, fields).alias("metric"), F.count(F.lit(1)).alias("matched_rows"))
    order = [_ordered(plan.sort_by or "metric", plan.sort_order)]
    return out.orderBy(*order, *[F.col(g).asc_nulls_last() for g in groups]).offset(plan.offset).limit(plan.limit)


def matched_stats(rows: DataFrame, plan: Plan, fields: list[Field]) -> DataFrame:
    return matched(rows, plan, fields).agg(F.count(F.lit(1)).alias("matched"), F.min("row_number").alias("first_row"), F.max("row_number").alias("last_row"))


def provenance(rows: DataFrame, plan: Plan, fields: list[Field], most: int = 200) -> DataFrame:
    return matched(rows, plan, fields).select("row_number").orderBy("row_number").limit(most)


def unit_stats(rows: DataFrame, plan: Plan, fields: list[Field], columns: list[str]) -> DataFrame:
    """Per unit column of the matched rows: how many units, how many blanks, the first five units. Units are made distinct before
    any are put together, and six rows of each column are the most that meet."""
    found = matched(rows, plan, fields)
    long = found.select(F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")))])).alias("unit_column", "unit"))
    units = long.groupBy("unit_column", "unit").agg(F.count(F.lit(1)).alias("n"))
    stats = units.groupBy("unit_column").agg(F.count(F.nullif("unit", F.lit(""))).alias("n_units"), F.coalesce(F.sum(F.when(F.col("unit") == "", F.col("n"))), F.lit(0)).alias("n_blank"))
    shown = units.where("unit <> ''").select("unit_column", F.substring("unit", 1, 41).alias("unit")).distinct()
    first = shown.withColumn("place", F.row_number().over(Window.partitionBy("unit_column").orderBy("unit"))).where("place <= 5")  # a group limit before the shuffle
    first = first.groupBy("unit_column").agg(F.array_sort(F.collect_list("unit")).alias("units"))
    return stats.join(first, "unit_column", "left").select("unit_column", "n_units", "n_blank", F.coalesce(F.array_join("units", "|"), F.lit("")).alias("units"))


def invalid_numbers(rows: DataFrame, plan: Plan, fields: list[Field]) -> DataFrame:
    """Matched rows whose measured cell is no number."""
    cell = F.col(f"`{plan.metric_column}`")
    return matched(rows, plan, fields).agg(F.sum((cell.isNotNull() & typed(cell, "number").isNull()).cast("long")).alias("invalid"))


def hints(plan: Plan, fields: list[Field]) -> list[dict]:
    """Where nothing matched: eq filters whose value is the parent of a sampled path."""
    from lodestone.functions.paths import direct_child_pattern
    import re

    known = {f.name: f for f in fields}
    out = []
    for f in plan.filters:
        own = known[f.column]
        if f.operator == "eq" and isinstance(f.value, str) and own.kind in ("text", "identifier") and any(re.search(direct_child_pattern(f.value), s) for s in own.samples):
            out.append({"column": f.column, "operator": "direct_child_of", "value": f.value})
    return out
