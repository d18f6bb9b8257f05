"""Queries under the names that the operator inventory uses, where they are combinations of others, and the remaining steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import store
from lodestone.catalog import table, tables
from lodestone.operators import chunking, fusion, profile, registry
from lodestone.operators import relations as R
from lodestone.operators.q_documents import BLOCKS, documents
from lodestone.operators.q_plan import DATASET, FIELDS, dataset
from lodestone.operators.q_search import CHUNKS, COVERS, LEXICAL, SCORE, chunks, index, rankings, scored
from lodestone.operators.registry import query
from lodestone.plans import compiler, units
from lodestone.plans.model import Field, PlanError, validate, validate_drafted
from lodestone.sources import snapshots, tables as cells

#: Inventory name: the query that has it.
SAME = {
    "filter_eq": "filter_eq_text", "filter_ne": "filter_ne_text", "filter_lte": "filter_lte_text", "sort_rows": "sort_rows_text_desc", "agg_min": "agg_min_number", "agg_max": "agg_max_date", "group_by": "group_by_two",
    "qa_recall_cjk": "qa_recall", "purge": "purge_orphans", "trash": "trash_restore", "source_url": "normalize_url",
    "row_fallback_executor": "row_compat_sum",
}
for _name, _other in SAME.items():
    query(_name, registry._SQL.get(_other))(registry._QUERIES[_other])


@query("infer_type", "SELECT * FROM (VALUES ('path', 'text'), ('segment', 'text'), ('amount', 'text'), ('day', 'date'), ('code', 'identifier')) t(name, kind)")
def infer_type(spark: SparkSession, sf: str) -> DataFrame:
    return profile.profile_fields(dataset(spark, sf), ["path", "segment", "amount", "day", "code"]).select("name", "kind")


@query("db_profile", "SELECT 'o_orderpriority' AS name, count(*) - count(o_orderpriority) AS n_null, count(DISTINCT o_orderpriority) AS n_distinct FROM orders UNION ALL SELECT 'o_orderstatus', count(*) - count(o_orderstatus), count(DISTINCT o_orderstatus) FROM orders")
def db_profile(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").withColumnRenamed("o_orderkey", "row_number")
    return profile.profile_fields(rows, ["o_orderpriority", "o_orderstatus"]).select("name", "n_null", "n_distinct")


@query("literal_discovery_rows", DATASET + "SELECT 'segment' AS name, max(segment) AS value FROM data WHERE segment = 'MACHINERY'")
def literal_discovery_rows(spark: SparkSession, sf: str) -> DataFrame:
    return profile.mentioned_values(dataset(spark, sf), ["segment"], "machinery, please", least=1)


@query("qa_recall_like", CHUNKS + "SELECT chunk_id FROM chunks WHERE contains(lower(content), 'tion') ORDER BY length(content), chunk_id LIMIT 40")
def qa_recall_like(spark: SparkSession, sf: str) -> DataFrame:
    return index(spark, sf).containing_any(["tion"]).orderBy("length", "chunk_id").select("chunk_id").limit(40)


@query("qa_recall_fts", COVERS + "SELECT chunk_id, round(r.rank + CASE WHEN contains(lower(content), 'with the') THEN 1 ELSE 0 END, 6) AS rank FROM ranks r JOIN chunks USING (chunk_id) ORDER BY 2 DESC, 1 LIMIT 40")
def qa_recall_fts(spark: SparkSession, sf: str) -> DataFrame:
    """The cover density of the question's words, and one more where the question is part of the text."""
    own = index(spark, sf)
    exact = own.containing_any(["with the"]).select("chunk_id", F.lit(1.0).alias("exact"))
    hits = own.cover_ranked(["with", "the"]).join(exact, "chunk_id", "left")
    rank = F.round(F.col("rank") + F.coalesce("exact", F.lit(0.0)), 6).alias("rank")
    return hits.select("chunk_id", rank).orderBy(F.desc("rank"), "chunk_id").limit(40)


@query("hybrid_chunks", CHUNKS + f""", lx AS (SELECT chunk_id, row_number() OVER (ORDER BY {SCORE} DESC, chunk_id) AS rank FROM chunks WHERE {SCORE} >= 2 ORDER BY rank LIMIT 40),
ln AS (SELECT chunk_id, row_number() OVER (ORDER BY length(content), chunk_id) AS rank FROM chunks WHERE {SCORE} >= 2 ORDER BY rank LIMIT 40), u AS (SELECT * FROM lx UNION ALL SELECT * FROM ln)
SELECT chunk_id, round(sum(1.0 / (60 + rank)), 8) AS score FROM u GROUP BY 1""")
def hybrid_chunks(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    hits = scored(spark, sf).select("chunk_id", "score", F.col("length").alias("n"))
    page = lambda *order: hits.orderBy(*order).limit(40).withColumn("rank", F.row_number().over(Window.orderBy(*order))).select("chunk_id", "rank")
    fused = fusion.rrf({"score": page(F.desc("score"), "chunk_id"), "length": page("n", "chunk_id")}, "chunk_id")
    return fused.select("chunk_id", F.round("score", 8).alias("score"))


@query("evidence_dataset", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def evidence_dataset(spark: SparkSession, sf: str) -> DataFrame:
    c, n, r = tables(spark, sf, "customer", "nation", "region")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "n_name", "r_name")


@query("structured_evidence", DATASET + "SELECT segment, sum(num) AS metric, count(*) AS matched_rows FROM typed GROUP BY 1 ORDER BY metric DESC NULLS LAST LIMIT 20")
def structured_evidence(spark: SparkSession, sf: str) -> DataFrame:
    plan = validate({"metric": "sum", "metric_column": "amount", "group_by": ["segment"], "sort_order": "desc", "limit": 20}, FIELDS)
    return compiler.compile_plan(dataset(spark, sf), plan, FIELDS)


@query("run_reads", "SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant' ORDER BY conv_id, turn LIMIT 30 OFFSET 10")
def run_reads(spark: SparkSession, sf: str) -> DataFrame:
    nested = table(spark, sf, "conversations").where("role = 'assistant'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("parts"))
    return nested.select("conv_id", F.inline("parts")).orderBy("conv_id", "turn").offset(10).limit(30)


@query("source_fingerprint", BLOCKS + "SELECT document_id, sha256(string_agg(kind || ':' || place || ':' || sha256(text), ',' ORDER BY place)) AS fingerprint FROM blocks GROUP BY 1")
def source_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    digest = F.sha2(F.col("text").cast("binary"), 256).alias("digest")
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "kind", digest))), lambda x: F.concat_ws(":", x["kind"], x["place"].cast("string"), x["digest"])), ",")
    return chunking.blocks(documents(spark, sf)).groupBy("document_id").agg(F.sha2(parts.cast("binary"), 256).alias("fingerprint"))


@query("measure_context_verdict", "SELECT * FROM (VALUES ('sum', 'blocked'), ('count', 'not_applicable'), ('grouped', 'grouped')) t(metric, verdict)")
def measure_context_verdict(spark: SparkSession, sf: str) -> DataFrame:
    fields = [Field("amount", "number"), Field("unit")]
    rows = dataset(spark, sf).select("row_number", "amount", F.col("segment").alias("unit"))
    out = []
    for name, raw in (("sum", {"metric": "sum", "metric_column": "amount"}), ("count", {"metric": "count"}), ("grouped", {"metric": "sum", "metric_column": "amount", "group_by": ["unit"]})):
        plan = validate(raw, fields)
        stats = [units.UnitStats(r["unit_column"], r["n_units"], r["n_blank"], tuple(r["units"].split("|"))) for r in compiler.unit_stats(rows, plan, fields, ["unit"]).collect()]  # a row per unit column
        out.append((name, units.verdict(plan, compiler.matched_stats(rows, plan, fields).first()["matched"], ["unit"], stats)))
    return spark.createDataFrame(out, "metric string, verdict string")


@query("query_hints", "SELECT 'path' AS \"column\", 'direct_child_of' AS operator, 'ASIA' AS value")
def query_hints(spark: SparkSession, sf: str) -> DataFrame:
    samples = [r["path"] for r in dataset(spark, sf).where("path like 'ASIA%'").orderBy("row_number").limit(8).select("path").collect()]
    fields = [Field("path", "text", tuple(samples))]
    plan = validate({"filters": [{"column": "path", "operator": "eq", "value": "ASIA"}]}, fields)
    return spark.createDataFrame([tuple(h.values()) for h in compiler.hints(plan, fields)], "column string, operator string, value string")


def _root(spark: SparkSession) -> str:
    """A new folder for snapshots in the shared one."""
    return store.new_path(spark, "snapshots")


@query("sink_snapshot", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation")
def sink_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """Publishes two versions of a table and reads the active one."""
    root, nation = _root(spark), table(spark, sf, "nation")
    snapshots.publish(nation.limit(3), root)
    snapshots.publish(nation, root)
    return snapshots.active(spark, root)


@query("import_db_snapshot", "SELECT state, count(*) AS n FROM (SELECT CASE WHEN c.c_custkey IS NULL THEN 'added' WHEN s.s_suppkey IS NULL THEN 'removed' WHEN c.c_nationkey = s.s_nationkey THEN 'unchanged' ELSE 'changed' END AS state FROM customer c FULL JOIN supplier s ON c.c_custkey = s.s_suppkey) GROUP BY 1")
def import_db_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """Publishes an import and then another as the next version, and tells what that changed, by key. An empty import changes nothing."""
    root = _root(spark)
    first = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation"))
    second = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation"))
    snapshots.publish(first, root)
    before = snapshots.active(spark, root)
    snapshots.publish(second, root)
    return snapshots.changes(before, snapshots.active(spark, root), "key").groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("sink_ndjson_stream", "SELECT '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS value FROM region")
def sink_ndjson_stream(spark: SparkSession, sf: str) -> DataFrame:
    return cells.as_json(table(spark, sf, "region"))


@query("freshness_policy", "WITH l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS last, date_diff('minute', max(ts), (SELECT max(ts) FROM events)) AS age FROM events GROUP BY 1) SELECT user_id, CASE WHEN age < 1440 THEN 'serve' WHEN last = 'error' THEN 'refuse' WHEN last = 'purchase' THEN 'serve_and_schedule' ELSE 'warn' END AS action FROM l")
def freshness_policy(spark: SparkSession, sf: str) -> DataFrame:
    """A user's last event dates their data and sets its mode; a day is the interval."""
    events = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    now = F.broadcast(events.agg(F.max("ts").alias("now")))
    last = R.latest(events, ["user_id"], ["ts", "event_id"]).join(now, F.lit(True))
    minutes = F.timestamp_diff("MINUTE", F.date_trunc("minute", "ts"), F.date_trunc("minute", "now"))
    mode = F.when(F.col("event_type") == "error", "strict").when(F.col("event_type") == "purchase", "background").otherwise("manual")
    state = R.freshness(minutes, F.lit(1440), F.lit(None).cast("string"))
    return last.select("user_id", R.freshness_action(state, mode).alias("action"))


@query("normalize_filter", "SELECT l_orderkey, array_to_string(list_sort(list_distinct(list_filter(list(l_partkey), lambda x: x > 0))), ',') AS ids, array_to_string(list_sort(list_distinct(list(l_returnflag))), ',') AS sources FROM lineitem GROUP BY 1")
def normalize_filter(spark: SparkSession, sf: str) -> DataFrame:
    """The parts and flags of an order's lines as a filter says them: positive, once each, in order."""
    raw = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("ids"), F.collect_list("l_returnflag").alias("sources"))
    said = lambda c: F.array_join(c.cast("array<string>"), ",")
    return raw.select("l_orderkey", said(R.filter_ids(F.col("ids"))).alias("ids"), said(R.filter_names(F.col("sources"))).alias("sources"))


@query("search_paging", LEXICAL + ", f AS (SELECT document_id, round(sum(1.0 / (60 + rank)), 12) AS score FROM u GROUP BY 1) SELECT document_id FROM f ORDER BY score DESC, document_id LIMIT 10 OFFSET 10")
def search_paging(spark: SparkSession, sf: str) -> DataFrame:
    """The second page of the fused documents."""
    fused = fusion.rrf(rankings(spark, sf))
    return fusion.page(fused, [F.round("score", 12).desc(), F.col("document_id")], limit=10, offset=10).select("document_id")


@query("record_turn", "SELECT conv_id, count(*) + 1 AS turns FROM conversations GROUP BY 1")
def record_turn(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").select("conv_id", "turn")
    added = R.latest(c, ["conv_id"], ["turn"]).select("conv_id", (F.col("turn") + 1).alias("turn"))
    return c.union(added).groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"))


@query("ask", None)
def ask(spark: SparkSession, sf: str) -> DataFrame:
    """The evidence an answer would cite: fused documents with their best chunk and the share of a budget each gets."""
    from lodestone.operators import evidence
    from lodestone.operators.q_more import collect_evidence

    found = collect_evidence(spark, sf)
    sizes = found.agg(F.collect_list(F.length("snippet")).alias("sizes")).select(evidence.fair_share(F.col("sizes"), 4000).alias("given"))
    return found.join(F.broadcast(sizes), F.lit(True)).select("document_id", "chunk_id", F.array_join(F.transform("given", lambda x: x.cast("string")), ",").alias("budget"))
