"""Scopes, facets, document status, change detection, monitoring and queues, as joins and conditional aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def count_where(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def merge_filters(a: Column, b: Column) -> Column:
    """The values both allow; null means unrestricted, and an empty array that nothing is left."""
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.array_sort(F.array_intersect(a, b)))


def filter_ids(ids: Column) -> Column:
    """Ids as a filter has them: positive, once each, in order."""
    return F.array_sort(F.array_distinct(F.filter(ids, lambda x: x > 0)))


def filter_names(names: Column) -> Column:
    return F.array_sort(F.array_distinct(names))


def selected(documents: DataFrame, keys: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents of the union of two id tables; two empty ones select nothing."""
    return documents.join(keys.select("document_id").union(ids.select("document_id")).distinct(), "document_id", "left_semi")


def facet_counts(values: DataFrame, documents: DataFrame, value: str, zeroes: bool = True) -> DataFrame:
    """Distinct documents by facet value; values without documents count 0, or are left out under a selection."""
    counts = documents.groupBy(value).agg(F.count_distinct("document_id").alias("n"))
    out = values.join(counts, value, "left").select(value, F.coalesce("n", F.lit(0)).alias("n"))
    return out if zeroes else out.where("n > 0")


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key, by a maximum that is combined before the shuffle."""
    others = [c for c in rows.columns if c not in key and c not in order]
    best = rows.groupBy(*key).agg(F.max(F.struct(*order, *others)).alias("b"))
    return best.select(*key, *[F.col(f"b.{c}").alias(c) for c in [*order, *others]])


def reconcile(known: DataFrame, remote: DataFrame, now: Column, confirmations: int = 2, grace_hours: int = 24) -> DataFrame:
    """What a scan of path, etag, mtime, size means for the known entries (the same, with misses and missing_since)."""
    k, r = known.alias("k"), remote.alias("r")
    same = F.col("k.etag").eqNullSafe(F.col("r.etag")) & F.col("k.mtime").eqNullSafe(F.col("r.mtime")) & F.col("k.size").eqNullSafe(F.col("r.size"))
    gone = F.col("r.path").isNull()
    misses = F.when(gone, F.col("k.misses") + 1).otherwise(0)
    overdue = F.coalesce(F.col("k.missing_since"), now) <= now - F.make_dt_interval(hours=F.lit(grace_hours))
    state = (
        F.when(F.col("k.path").isNull(), "discovered").when(gone & (misses >= confirmations) & overdue, "missing").when(gone, "suspected_missing")
        .when(F.col("k.misses") > 0, "restored").when(same, "unchanged").otherwise("changed")
    )
    return k.join(r, F.col("k.path") == F.col("r.path"), "full").select(F.coalesce("k.path", "r.path").alias("path"), state.alias("state"), F.coalesce(misses, F.lit(0)).alias("misses"))


def freshness(age_minutes: Column, interval: Column, error: Column) -> Column:
    """local data needs no refresh; a snapshot is stale with an error, without a time, or past its interval."""
    age = F.greatest(age_minutes, F.lit(0))
    return F.when(interval.isNull(), "not_applicable").when(error.isNotNull() | age.isNull() | (age >= interval), "stale").otherwise("fresh")


def browse(entries: DataFrame, prefix: str, limit: int = 100, offset: int = 0) -> DataFrame:
    """Folders of the next level with their counts, then files; the set union of two groupings."""
    under = entries.where(F.col("path").startswith(prefix)).withColumn("rest", F.substring("path", len(prefix) + 1, 1 << 30))
    folders = under.where(F.contains("rest", F.lit("/"))).groupBy(F.substring_index("rest", "/", 1).alias("name")).agg(F.lit("folder").alias("kind"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("failed")).alias("n_failed"))
    files = under.where(~F.contains("rest", F.lit("/"))).select(F.col("rest").alias("name"), F.lit("file").alias("kind"), F.lit(1).cast("long").alias("n"), F.col("failed").cast("long").alias("n_failed"))
    return folders.unionByName(files).orderBy(F.desc("kind"), "name").offset(offset).limit(limit)


def backoff_seconds(failures: Column, least: int = 60, most: int = 3600, cap: int = 8) -> Column:
    return F.least(F.lit(most), least * F.pow(F.lit(2.0), F.least(failures, F.lit(cap)))).cast("long")


def fair_order(jobs: DataFrame, stage: str, order: list[str], turns: int) -> DataFrame:
    """One job of each stage in turn: the place inside the stage first, then the stage. A page of so many jobs has no later turn, and
    Spark applies that limit of a group before the shuffle too, so no stage's jobs meet in one task."""
    return jobs.withColumn("turn", F.row_number().over(Window.partitionBy(stage).orderBy(*order))).where(F.col("turn") <= turns)


def freshness_action(state: Column, mode: Column) -> Column:
    """What a stale dataset's mode means: strict refuses, background serves and schedules a refresh, manual warns. Others are served."""
    return F.when(state != "stale", "serve").when(mode == "strict", "refuse").when(mode == "background", "serve_and_schedule").otherwise("warn")


def set_values(rows: DataFrame, chosen: DataFrame, key: str, column: str, value: str) -> DataFrame:
    """One value for the chosen rows of a table, the old one for the others."""
    marks = chosen.select(key).distinct().withColumn("chosen", F.lit(True))
    return rows.join(marks, key, "left").withColumn(column, F.when(F.col("chosen"), F.lit(value)).otherwise(F.col(column))).drop("chosen")


def next_stage(done: Column, stages: list[str]) -> Column:
    """The first stage of a chain that is not among those done; null where all are."""
    return F.get(F.filter(F.array(*[F.lit(s) for s in stages]), lambda s: ~F.array_contains(done, s)), F.lit(0))


def missing_vectors(documents: DataFrame, vectors: DataFrame, dimension: int) -> DataFrame:
    """document_id and reason (missing or dimension) of each document without a usable vector."""
    j = documents.select("document_id").join(vectors.select("document_id", F.size("embedding").alias("n")), "document_id", "left")
    return j.where(F.col("n").isNull() | (F.col("n") != dimension)).select("document_id", F.when(F.col("n").isNull(), "missing").otherwise("dimension").alias("reason"))


def visible(documents: DataFrame, hidden: DataFrame) -> DataFrame:
    """Documents that no rule hides."""
    return documents.join(hidden.select("document_id"), "document_id", "left_anti")


def hourly(events: DataFrame, now: Column, days: int = 31) -> DataFrame:
    """The last value of each metric in each hour of the days kept."""
    kept = events.where(F.col("ts") >= now - F.make_dt_interval(days=F.lit(days)))
    return kept.groupBy(F.date_trunc("hour", "ts").alias("hour"), "metric").agg(F.max_by("value", F.struct("ts", "id")).alias("value"))


def hierarchy(n_windows: int, fan: int = 4) -> list[tuple[int, int, int, int]]:
    """level, ordinal, first and last window of the nodes over n windows, until one is left."""
    out, width, level = [], 1, 0
    while n_windows and (level == 0 or -(-n_windows // width) > 1 or not out):
        width *= fan
        level += 1
        count = -(-n_windows // width)
        out += [(level, i, i * width, min(n_windows, (i + 1) * width) - 1) for i in range(count)]
        if count == 1:
            break
    return out


def new_information(rows: DataFrame, keys: list[str], order: list[str], found: str) -> DataFrame:
    """Of the rows of each group, those whose finding no earlier row of it has; the earliest combine before the shuffle."""
    first = F.min(F.struct(*order)).alias("first")
    return rows.groupBy(*keys, found).agg(first).select(*keys, *[F.col("first")[c].alias(c) for c in order], found)


def output_verdict(text: Column, contract: str) -> Column:
    """Whether a JSON text keeps to a contract, given as the schema of its variant: ok, not_json, or wrong_shape (missing, further or wrongly typed fields)."""
    value = F.try_parse_json(text)
    return F.when(value.isNull(), "not_json").when(F.schema_of_variant(value) == contract, "ok").otherwise("wrong_shape")


#: Modules that may be enhanced, and the calls that one run may have (fixed values).
ENHANCED, CALLS = ("chapter", "graph", "chunking", "overview"), (1, 32)


def enhancement_verdict(enabled: Column, acknowledged: Column, modules: Column, calls: Column) -> Column:
    """disabled unless asked for; then the first rule that a policy breaks, or ok."""
    return (
        F.when(~F.coalesce(enabled, F.lit(False)), "disabled").when(~F.coalesce(acknowledged, F.lit(False)), "cost_not_acknowledged")
        .when(F.size(F.array_except(modules, F.array(*map(F.lit, ENHANCED)))) > 0, "unknown_module").when(~F.coalesce(calls.between(*CALLS), F.lit(False)), "bad_budget").otherwise("ok")
    )
