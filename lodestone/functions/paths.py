"""Hierarchical paths: segments between - / ＞ or >."""

from __future__ import annotations

import re

from pyspark.sql import Column

#: What stands between the parts of a path (fixed values).
SEPARATORS = "-/＞>"


def direct_child_pattern(parent: str) -> str:
    quoted = re.sub(r"([^\w\s])", r"\\\1", parent.strip())
    return f"(^|[{SEPARATORS}]){quoted}[{SEPARATORS}][^{SEPARATORS}]+$"


def is_direct_child(path: Column, parent: str) -> Column:
    """One segment below the parent segment, and no more."""
    return path.rlike(direct_child_pattern(parent))
