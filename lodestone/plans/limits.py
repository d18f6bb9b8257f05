"""Time limits of a query: a page that takes longer is cancelled and reported, never shown in part."""

from __future__ import annotations

import threading
import time
import uuid

from pyspark.sql import DataFrame, Row

from lodestone.plans.model import PlanError

#: Seconds that a page may take (fixed value).
SECONDS = 20.0


def page_within(page: DataFrame, seconds: float = SECONDS) -> list[Row]:
    """The rows of a page (200 at most, by its plan), or PlanError query_timeout; its jobs carry a tag by which they are cancelled."""
    context, tag = page.sparkSession.sparkContext, f"page-{uuid.uuid4().hex}"
    began = time.monotonic()
    clock = threading.Timer(seconds, lambda: context.cancelJobsWithTag(tag))
    context.addJobTag(tag)
    clock.start()
    try:
        rows = page.collect()
    except Exception:
        if time.monotonic() - began < seconds:
            raise
        rows = None
    finally:
        clock.cancel()
        context.removeJobTag(tag)
    if rows is None or time.monotonic() - began > seconds:
        raise PlanError("query_timeout", f"the page took more than {seconds} seconds")
    return rows
