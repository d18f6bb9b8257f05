"""Whether a measure may be added up: the units of the matched rows must agree."""

from __future__ import annotations

from dataclasses import dataclass

from lodestone.plans.model import Plan

#: Names of unit and currency columns (fixed values).
UNIT_NAMES = {"单位", "计量单位", "币种", "货币", "unit", "units", "currency", "uom"}
MAX_COLUMNS, LONGEST = 4, 40


@dataclass(frozen=True)
class UnitStats:
    column: str
    n_units: int
    n_blank: int
    units: tuple[str, ...]


def unit_columns(names: list[str]) -> list[str]:
    return [n for n in names if n.strip().lower() in UNIT_NAMES]


def verdict(plan: Plan, matched: int, candidates: list[str], stats: list[UnitStats]) -> str:
    """not_applicable, unknown, grouped, blocked or known; blocked counts most, then unknown, grouped and known."""
    if plan.metric in ("rows", "count", "count_distinct"):
        return "not_applicable"
    if not matched or not candidates:
        return "unknown"
    if len(candidates) > MAX_COLUMNS:
        return "blocked"
    found = set()
    for s in stats:
        if s.column in plan.group_by:
            found.add("grouped")
        elif s.n_units == 0:
            found.add("unknown")
        elif s.n_units > 1 or s.n_blank:
            found.add("blocked")
        else:
            found.add("unknown" if any(len(u) > LONGEST for u in s.units) else "known")
    return next(v for v in ("blocked", "unknown", "grouped", "known") if v in found)


def covers(rows_of_groups: list[int], matched: int) -> bool:
    """Whether the groups shown hold every matched row; a page that leaves units out is blocked."""
    return sum(rows_of_groups) >= matched


def withheld(verdict_: str, rows: list, matched: int) -> dict:
    """The answer of a blocked measure has its counts but no rows."""
    blocked = verdict_ == "blocked"
    return {"rows": [] if blocked else rows, "matched_rows": matched, "warnings": ["units differ; the measure is withheld"] if blocked else []}
