"""From a question to an answered plan, without a model: literals that suffice become the filters, else drafted plans are tried, and an
empty answer may be refined once."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from lodestone.operators import profile
from lodestone.plans import compiler
from lodestone.plans.limits import page_within
from lodestone.plans.model import MAX_LIMIT, Field, Filter, Plan, PlanError, validate_drafted

ATTEMPTS = 2


@dataclass(frozen=True)
class Answer:
    """origin is literals, draft or refined."""

    origin: str
    plan: Plan
    rows: list[Row]


def literal_plan(rows: DataFrame, fields: list[Field], question: str, metric: str = "rows") -> Plan | None:
    """A plan of eq filters on the values that the question mentions, if they express all of it."""
    texts = [f.name for f in fields if f.kind in ("text", "date")]
    found = profile.mentioned_values(rows, texts, question).collect()  # a row per column
    values = F.array(*[F.lit(r["value"]) for r in found]).cast("array<string>")
    complete = rows.sparkSession.range(1).select(profile.literals_suffice(F.lit(question), values)).first()[0]
    filters = tuple(Filter(r["name"], "eq", r["value"]) for r in sorted(found))
    return Plan(filters=filters, metric=metric, limit=MAX_LIMIT) if complete else None


def first_valid(drafts: list[object], fields: list[Field]) -> Plan:
    """The first of two drafts that is a plan; the error of the last one otherwise."""
    error = PlanError("invalid_query", "no plan was drafted")
    for draft in drafts[:ATTEMPTS]:
        try:
            return validate_drafted(draft, fields)
        except PlanError as wrong:
            error = wrong
    raise error


def answer(rows: DataFrame, fields: list[Field], question: str, drafts: list[object], refinement: object = None, metric: str = "rows") -> Answer:
    """A refinement runs once, where nothing was found, and only if it asks the same of the same rows."""
    plan = literal_plan(rows, fields, question, metric)
    origin = "literals" if plan else "draft"
    plan = plan or first_valid(drafts, fields)
    page = page_within(compiler.compile_plan(rows, plan, fields))
    if not page and refinement is not None:
        other = validate_drafted(refinement, fields)
        if replace(other, filters=()) != replace(plan, filters=()) and (other.filters, other.metric, other.metric_column) == (plan.filters, plan.metric, plan.metric_column):
            origin, plan = "refined", other
            page = page_within(compiler.compile_plan(rows, plan, fields))
    return Answer(origin, plan, page)
