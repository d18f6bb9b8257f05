"""The dataset plan: what a caller may ask for, and its validation against the fields of the dataset."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Names and limits of the plan interface (fixed values).
OPERATORS = ("eq", "ne", "gt", "gte", "lt", "lte", "contains", "starts_with", "ends_with", "direct_child_of", "in")
METRICS = ("rows", "count", "count_distinct", "sum", "avg", "min", "max")
MAX_FILTERS, MAX_GROUPS, MAX_IN, MAX_LIMIT, MAX_OFFSET = 8, 3, 100, 200, 1_000_000
KEYS = {"filters", "columns", "group_by", "metric", "metric_column", "sort_by", "sort_order", "limit", "offset"}


class PlanError(ValueError):
    """code is invalid_query (not a plan) or query_failed (a plan that its types rule out)."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


@dataclass(frozen=True)
class Filter:
    column: str
    operator: str
    value: object


@dataclass(frozen=True)
class Plan:
    filters: tuple[Filter, ...] = ()
    columns: tuple[str, ...] = ()
    group_by: tuple[str, ...] = ()
    metric: str = "rows"
    metric_column: str | None = None
    sort_by: str | None = None
    sort_order: str = "asc"
    limit: int = 50
    offset: int = 0

    def echo(self) -> dict:
        """The plan as it was understood, for the caller; never SQL."""
        return {
            "filters": [vars(f) for f in self.filters], "columns": list(self.columns), "group_by": list(self.group_by), "metric": self.metric,
            "metric_column": self.metric_column, "sort_by": self.sort_by, "sort_order": self.sort_order, "limit": self.limit, "offset": self.offset,
        }


@dataclass(frozen=True)
class Field:
    name: str
    kind: str = "text"
    samples: tuple[str, ...] = field(default=())


def _refuse(condition: bool, message: str) -> None:
    if condition:
        raise PlanError("invalid_query", message)


def _whole(value: object, least: int, most: int, name: str) -> int:
    _refuse(isinstance(value, bool) or not isinstance(value, int) or not least <= value <= most, f"{name} must be a whole number from {least} to {most}")
    return value


def _filter(raw: object, fields: dict[str, Field]) -> Filter:
    _refuse(not isinstance(raw, dict), "a filter is an object")
    keys = set(raw)
    _refuse(keys not in ({"column", "operator", "value"}, {"column", "op", "value"}), "a filter has column, operator and value")
    column, operator, value = raw["column"], raw.get("operator", raw.get("op")), raw["value"]
    _refuse(column not in fields, f"unknown column {column!r}")
    _refuse(operator not in OPERATORS, f"unknown operator {operator!r}")
    if operator == "in":
        _refuse(not isinstance(value, list) or len(value) > MAX_IN, f"in takes a list of {MAX_IN} values at most")
        _refuse(any(isinstance(v, (list, dict)) or v is None for v in value), "in takes scalars")
        value = tuple(value)
    else:
        _refuse(isinstance(value, (list, dict, tuple)), f"{operator} takes a scalar")
        _refuse(value is None and operator not in ("eq", "ne"), f"{operator} takes no null")
    return Filter(column, operator, value)


def validate(raw: object, fields: list[Field]) -> Plan:
    """A plan of known columns and operators within the limits, or PlanError."""
    _refuse(not isinstance(raw, dict), "a plan is an object")
    _refuse(bool(set(raw) - KEYS), f"unknown keys {sorted(set(raw) - KEYS)}")
    known = {f.name: f for f in fields}
    filters = raw.get("filters") or []
    _refuse(not isinstance(filters, list) or len(filters) > MAX_FILTERS, f"{MAX_FILTERS} filters at most")
    columns, groups = raw.get("columns") or [], raw.get("group_by") or []
    for name, own in (("columns", columns), ("group_by", groups)):
        _refuse(not isinstance(own, list) or any(c not in known for c in own), f"{name} must be known columns")
        _refuse(len(set(own)) != len(own), f"{name} has repeats")
    _refuse(len(groups) > MAX_GROUPS, f"{MAX_GROUPS} group columns at most")
    metric, measured = raw.get("metric", "rows"), raw.get("metric_column")
    _refuse(metric not in METRICS, f"unknown metric {metric!r}")
    _refuse(metric == "rows" and bool(groups), "rows cannot be grouped")
    _refuse(metric not in ("rows", "count") and measured is None, f"{metric} needs metric_column")
    _refuse(measured is not None and measured not in known, f"unknown column {measured!r}")
    sort_by, order = raw.get("sort_by"), raw.get("sort_order", "asc")
    allowed = {*known, "row_number"} if metric == "rows" else {*groups, "metric", "matched_rows"}
    _refuse(sort_by is not None and sort_by not in allowed, f"cannot sort by {sort_by!r}")
    _refuse(order not in ("asc", "desc"), "sort_order is asc or desc")
    limit = _whole(raw.get("limit", 50), 1, MAX_LIMIT, "limit")
    offset = _whole(raw.get("offset", 0), 0, MAX_OFFSET, "offset")
    return Plan(tuple(_filter(f, known) for f in filters), tuple(columns), tuple(groups), metric, measured, sort_by, order, limit, offset)


def validate_drafted(raw: object, fields: list[Field]) -> Plan:
    """For plans drafted from a question: count and descending by default, 20 rows, 50 at most."""
    _refuse(not isinstance(raw, dict), "a plan is an object")
    raw = {"metric": "count", "sort_order": "desc"} | {k: v for k, v in raw.items() if v is not None}
    limit = raw.get("limit") or 20
    raw["limit"] = min(limit, 50) if isinstance(limit, int) else limit
    return validate(raw, fields)
