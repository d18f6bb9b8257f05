"""Typed views of text cells: numbers, dates and booleans as people write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A displayed value may carry the raw one (fixed format).
RAW_VALUE = "（原始值：([^）]*)）$"
#: What may stand around the digits of a number (fixed values).
NUMBER_NOISE = r"[,，\s￥¥$元%]"
ISO_DATE = r"^\s*\d{4}[-/]\d{1,2}[-/]\d{1,2}\s*$"
DATE_PARTS = r"^\s*(\d{4})[-/.年](\d{1,2})[-/.月](\d{1,2})日?\s*$"
BOOLEAN_WORDS = ["true", "false", "yes", "no", "是", "否"]


def number(text: Column) -> Column:
    """DOUBLE of a cell: the raw value if it carries one, else the digits, by 100 where it ends in a percent sign."""
    raw = F.regexp_extract(text, RAW_VALUE, 1)
    bare = F.regexp_replace(text, NUMBER_NOISE, "").try_cast("double")
    scaled = F.when(F.trim(text).endswith("%"), bare / F.lit(100.0)).otherwise(bare)
    return F.when(text.rlike(RAW_VALUE), raw.try_cast("double")).otherwise(scaled)


def exact_number(text: Column) -> Column:
    """The same as DECIMAL(38,18), for sums that must not depend on their order."""
    raw = F.regexp_extract(text, RAW_VALUE, 1)
    bare = F.regexp_replace(text, NUMBER_NOISE, "").try_cast("decimal(38,18)")
    scaled = F.when(F.trim(text).endswith("%"), (bare / F.lit(100)).cast("decimal(38,18)")).otherwise(bare)
    return F.when(text.rlike(RAW_VALUE), raw.try_cast("decimal(38,18)")).otherwise(scaled)


def date(text: Column) -> Column:
    """DATE of an ISO cell, with - or / between its three parts; a year or a month alone is no day."""
    return F.when(text.rlike(ISO_DATE), F.replace(F.trim(text), F.lit("/"), F.lit("-")).try_cast("date"))


def calendar_date(text: Column) -> Column:
    """DATE of any of the written forms, null where the day does not exist."""
    part = lambda i: F.regexp_extract(text, DATE_PARTS, i)
    joined = F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0"))
    return F.when(text.rlike(DATE_PARTS), joined.try_cast("date"))


def is_boolean(text: Column) -> Column:
    return F.lower(F.trim(text)).isin(BOOLEAN_WORDS)


def typed(text: Column, kind: str) -> Column:
    """The view of a cell that comparisons and measures use."""
    return number(text) if kind == "number" else date(text) if kind == "date" else text
