"""Queries of scopes, facets, document status, change detection, monitoring and queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.catalog import table, tables
from lodestone.operators import relations as R
from lodestone.operators.registry import query

NOW = "TIMESTAMP '2024-01-31 00:00:00'"


def now():
    return F.lit("2024-01-31 00:00:00").cast("timestamp")


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").withColumnRenamed("doc_id", "document_id")


# scopes and facets


@query("merge_filters", """WITH x AS (SELECT l_orderkey, list(l_linenumber) FILTER (WHERE l_discount > 0.05) AS a, list(l_linenumber) FILTER (WHERE l_tax > 0.04) AS b FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN a IS NULL THEN array_to_string(list_sort(list_distinct(b)), ',') WHEN b IS NULL THEN array_to_string(list_sort(list_distinct(a)), ',') ELSE array_to_string(list_sort(list_distinct(list_filter(a, lambda v: list_contains(b, v)))), ',') END AS merged FROM x""")
def merge_filters(spark: SparkSession, sf: str) -> DataFrame:
    """Two restrictions of an order's lines; one that names no line restricts nothing."""
    named = lambda rule: F.array_sort(F.collect_set(F.when(F.expr(rule), F.col("l_linenumber"))))
    sets = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(named("l_discount > 0.05").alias("a"), named("l_tax > 0.04").alias("b"))
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    return sets.select("l_orderkey", F.array_join(R.merge_filters(some("a"), some("b")), ",").alias("merged"))


@query("selection_condition", "SELECT doc_id AS document_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) OR doc_id IN (SELECT item_id FROM benchmark)")
def selection_condition(spark: SparkSession, sf: str) -> DataFrame:
    labels, benchmark = tables(spark, sf, "labels", "benchmark")
    keys = labels.where("toxic = 1").select(F.col("doc_id").alias("document_id"))
    return R.selected(docs(spark, sf), keys, benchmark.select(F.col("item_id").alias("document_id"))).select("document_id")


@query("selection_empty", "SELECT doc_id AS document_id FROM documents WHERE false")
def selection_empty(spark: SparkSession, sf: str) -> DataFrame:
    none = docs(spark, sf).where("false").select("document_id")
    return R.selected(docs(spark, sf), none, none).select("document_id")


@query("resolve_scope", "SELECT d.doc_id AS document_id FROM documents d WHERE d.lang IN ('de', 'fr') AND d.source NOT IN ('src3') AND EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def resolve_scope(spark: SparkSession, sf: str) -> DataFrame:
    linked = table(spark, sf, "labels").select(F.col("doc_id").alias("document_id"))
    return docs(spark, sf).where(F.col("lang").isin("de", "fr") & ~F.col("source").isin("src3")).join(linked, "document_id", "left_semi").select("document_id")


@query("connector_documents", "SELECT DISTINCT l.doc_id AS document_id FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE l.quality = 0")
def connector_documents(spark: SparkSession, sf: str) -> DataFrame:
    entries = table(spark, sf, "labels").where("quality = 0").select(F.col("doc_id").alias("document_id"))
    return entries.join(docs(spark, sf), "document_id").select("document_id").distinct()


@query("facet_counts", "WITH v AS (SELECT DISTINCT source FROM documents UNION SELECT 'none') SELECT 'source' AS facet, v.source AS value, count(DISTINCT doc_id) AS n FROM v LEFT JOIN (SELECT * FROM documents WHERE lang = 'es') d ON d.source = v.source GROUP BY 2")
def facet_counts(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf)
    values = d.select("source").distinct().union(spark.createDataFrame([("none",)], "source string"))
    return R.facet_counts(values, d.where("lang = 'es'"), "source").select(F.lit("source").alias("facet"), F.col("source").alias("value"), "n")


@query("facet_counts_selected", "SELECT source AS value, count(DISTINCT doc_id) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY 1")
def facet_counts_selected(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf)
    chosen = table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("document_id"))
    return R.facet_counts(d.select("source").distinct(), d.join(chosen, "document_id", "left_semi"), "source", zeroes=False).select(F.col("source").alias("value"), "n")


@query("category_counts", "SELECT d.lang AS category, count(DISTINCT l.doc_id) AS n FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND l.quality = 1 GROUP BY 1")
def category_counts(spark: SparkSession, sf: str) -> DataFrame:
    good = table(spark, sf, "labels").where("quality = 1").select("doc_id")
    d = table(spark, sf, "documents").select("doc_id", "lang")
    return d.join(good.withColumn("id", F.col("doc_id")), "doc_id", "left").groupBy(F.col("lang").alias("category")).agg(F.count_distinct("id").alias("n"))


@query("category_documents", "SELECT doc_id FROM documents WHERE lang = 'en' ORDER BY doc_id DESC LIMIT 200")
def category_documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("lang = 'en'").select("doc_id").orderBy(F.desc("doc_id")).limit(200)


@query("tag_merge", """WITH l AS (SELECT doc_id, source AS tag FROM documents UNION ALL SELECT doc_id, 'src1' FROM documents WHERE doc_id % 7 = 0)
SELECT DISTINCT doc_id, CASE WHEN tag = 'src2' THEN 'src1' ELSE tag END AS tag FROM l""")
def tag_merge(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    links = d.select("doc_id", F.col("source").alias("tag")).union(d.where("doc_id % 7 = 0").select("doc_id", F.lit("src1")))
    kept = links.where("tag <> 'src2'")
    moved = links.where("tag = 'src2'").join(kept.where("tag = 'src1'").select("doc_id"), "doc_id", "left_anti")
    return kept.union(moved.select("doc_id", F.lit("src1"))).distinct()


@query("tag_usage", "SELECT source AS tag, count(*) AS n FROM documents GROUP BY 1")
def tag_usage(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy(F.col("source").alias("tag")).agg(F.count(F.lit(1)).alias("n"))


@query("tag_suggestion_filter", "SELECT doc_id, quality FROM labels WHERE doc_id * 37 % 100 >= 70 AND doc_id IN (SELECT doc_id FROM documents)")
def tag_suggestion_filter(spark: SparkSession, sf: str) -> DataFrame:
    labels, documents = tables(spark, sf, "labels", "documents")
    return labels.where("doc_id * 37 % 100 >= 70").join(documents.select("doc_id"), "doc_id", "left_semi").select("doc_id", "quality")


@query("understanding_apply", "SELECT d.doc_id, coalesce(CASE WHEN l.quality = 1 THEN 'good' END, CASE WHEN d.lang IN ('en', 'fr') THEN d.lang ELSE 'inbox' END) AS category FROM documents d LEFT JOIN labels l USING (doc_id)")
def understanding_apply(spark: SparkSession, sf: str) -> DataFrame:
    """The user's category stays; else the model's, or the inbox where it is unknown."""
    d, labels = tables(spark, sf, "documents", "labels")
    own = labels.select("doc_id", F.when(F.col("quality") == 1, "good").alias("own"))
    model = F.when(F.col("lang").isin("en", "fr"), F.col("lang")).otherwise("inbox")
    return d.join(own, "doc_id", "left").select("doc_id", F.coalesce("own", model).alias("category"))


@query("workspace_filter", "SELECT doc_id, source FROM documents WHERE source = 'src5'")
def workspace_filter(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where(F.col("source") == "src5").select("doc_id", "source")


# documents and their status


@query("list_current_documents", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P' ORDER BY o_orderkey DESC LIMIT 50 OFFSET 25")
def list_current_documents(spark: SparkSession, sf: str) -> DataFrame:
    o, c = tables(spark, sf, "orders", "customer")
    return o.where("o_orderstatus <> 'P'").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name").orderBy(F.desc("o_orderkey")).offset(25).limit(50)


@query("latest_job", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
def latest_job(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"))
    return rows


@query("pipeline_status", """WITH last AS (SELECT user_id, event_type, arg_max(value, event_id) AS v, count(*) AS n FROM events GROUP BY 1, 2), s AS (SELECT user_id, max(CASE WHEN event_type = 'error' THEN n END) AS errors, max(CASE WHEN event_type = 'purchase' THEN v END) AS done, max(CASE WHEN event_type = 'view' THEN v END) AS parsed FROM last GROUP BY 1)
SELECT user_id, CASE WHEN coalesce(errors, 0) > 20 THEN 'failed' WHEN done IS NULL THEN 'waiting' WHEN done > parsed THEN 'ready' ELSE 'running' END AS status FROM s""")
def pipeline_status(spark: SparkSession, sf: str) -> DataFrame:
    last = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max_by("value", "event_id").alias("v"), F.count(F.lit(1)).alias("n"))
    of = lambda kind, c: F.max(F.when(F.col("event_type") == kind, F.col(c)))
    s = last.groupBy("user_id").agg(of("error", "n").alias("errors"), of("purchase", "v").alias("done"), of("view", "v").alias("parsed"))
    return s.select("user_id", F.when(F.coalesce("errors", F.lit(0)) > 20, "failed").when(F.col("done").isNull(), "waiting").when(F.col("done") > F.col("parsed"), "ready").otherwise("running").alias("status"))


@query("inbox", """SELECT count(*) AS total, count(*) FILTER (WHERE text IS NULL OR length(text) < 40) AS short, count(*) FILTER (WHERE l.doc_id IS NULL) AS unlabelled, count(*) FILTER (WHERE l.toxic = 1) AS flagged, count(*) FILTER (WHERE n_chars > 5000) AS long FROM documents d LEFT JOIN labels l USING (doc_id)""")
def inbox(spark: SparkSession, sf: str) -> DataFrame:
    d, labels = tables(spark, sf, "documents", "labels")
    d = d.join(labels.withColumn("linked", F.lit(True)), "doc_id", "left")
    return d.agg(F.count(F.lit(1)).alias("total"), R.count_where(F.col("text").isNull() | (F.length("text") < 40)).alias("short"), R.count_where(F.col("linked").isNull()).alias("unlabelled"), R.count_where(F.col("toxic") == 1).alias("flagged"), R.count_where(F.col("n_chars") > 5000).alias("long"))


@query("document_overview", """WITH p AS (SELECT doc_id, lang FROM documents ORDER BY doc_id DESC LIMIT 40) SELECT p.doc_id, p.lang, l.quality, b.item_id IS NOT NULL AS tested FROM p LEFT JOIN labels l USING (doc_id) LEFT JOIN benchmark b ON b.item_id = p.doc_id""")
def document_overview(spark: SparkSession, sf: str) -> DataFrame:
    d, labels, benchmark = tables(spark, sf, "documents", "labels", "benchmark")
    page = d.select("doc_id", "lang").orderBy(F.desc("doc_id")).limit(40)  # a page is small whatever the table is
    return F.broadcast(page).join(labels.select("doc_id", "quality"), "doc_id", "left").join(benchmark.select(F.col("item_id").alias("doc_id"), F.lit(True).alias("t")), "doc_id", "left").select("doc_id", "lang", "quality", F.col("t").isNotNull().alias("tested"))


@query("content_kind", "SELECT doc_id, CASE WHEN contains(text, ' | ') THEN 'dataset' WHEN length(text) > 8000 THEN 'document' WHEN length(text) > 1000 THEN 'article' ELSE 'note' END AS kind FROM documents")
def content_kind(spark: SparkSession, sf: str) -> DataFrame:
    n = F.length("text")
    return table(spark, sf, "documents").select("doc_id", F.when(F.contains("text", F.lit(" | ")), "dataset").when(n > 8000, "document").when(n > 1000, "article").otherwise("note").alias("kind"))


@query("purge_orphans", "WITH b AS (SELECT sha256(text) AS h, doc_id FROM documents) SELECT DISTINCT h FROM b WHERE doc_id % 3 = 0 AND h NOT IN (SELECT h FROM b WHERE doc_id % 3 <> 0)")
def purge_orphans(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "documents").select(F.sha2(F.col("text").cast("binary"), 256).alias("h"), "doc_id")
    return b.where("doc_id % 3 = 0").select("h").distinct().join(b.where("doc_id % 3 <> 0"), "h", "left_anti")


@query("system_status", "SELECT count(DISTINCT CASE WHEN event_type IN ('view', 'click') THEN user_id END) AS active, count(DISTINCT CASE WHEN event_type = 'error' THEN user_id END) AS failed, bool_or(value > 90) AS any_large FROM events")
def system_status(spark: SparkSession, sf: str) -> DataFrame:
    of = lambda *kinds: F.count_distinct(F.when(F.col("event_type").isin(*kinds), F.col("user_id")))
    return table(spark, sf, "events").agg(of("view", "click").alias("active"), of("error").alias("failed"), F.bool_or(F.col("value") > 90).alias("any_large"))


@query("ask_history", "SELECT c.conv_id, c.role, t.n AS turns, t.last FROM (SELECT DISTINCT conv_id, 'owner' AS role FROM conversations) c LEFT JOIN (SELECT conv_id, count(*) AS n, max(turn) AS last FROM conversations WHERE role = 'user' GROUP BY 1 HAVING count(*) > 1) t USING (conv_id) ORDER BY t.last DESC NULLS LAST, c.conv_id LIMIT 60")
def ask_history(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    t = c.where("role = 'user'").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.max("turn").alias("last")).where("turns > 1")
    return c.select("conv_id", F.lit("owner").alias("role")).distinct().join(t, "conv_id", "left").orderBy(F.col("last").desc_nulls_last(), "conv_id").limit(60)


@query("snapshot_counts", "SELECT count(*) AS n, count(*) FILTER (WHERE o_totalprice < 1000) AS small FROM orders")
def snapshot_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").agg(F.count(F.lit(1)).alias("n"), R.count_where(F.col("o_totalprice") < 1000).alias("small"))


@query("dataset_summary", "SELECT count(DISTINCT c_custkey) AS datasets, count(DISTINCT c_nationkey) AS documents, count(DISTINCT o_custkey) AS ready FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F'")
def dataset_summary(spark: SparkSession, sf: str) -> DataFrame:
    c, o = tables(spark, sf, "customer", "orders")
    ready = o.where("o_orderstatus = 'F'").select("o_custkey").distinct()
    return c.join(ready, F.col("o_custkey") == F.col("c_custkey"), "left").agg(F.count_distinct("c_custkey").alias("datasets"), F.count_distinct("c_nationkey").alias("documents"), F.count_distinct("o_custkey").alias("ready"))


# embeddings of chunks


@query("coverage_check", "SELECT d.doc_id FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id AND e.label = d.doc_id % 5 WHERE e.vec_id IS NULL")
def coverage_check(spark: SparkSession, sf: str) -> DataFrame:
    d, e = tables(spark, sf, "documents", "embeddings")
    have = e.select(F.col("vec_id").alias("doc_id"), F.col("label").cast("long").alias("tag"))
    return d.select("doc_id", (F.col("doc_id") % 5).alias("tag")).join(have, ["doc_id", "tag"], "left_anti").select("doc_id")


@query("progress_aggregate", "SELECT count(DISTINCT d.doc_id) AS total, count(DISTINCT e.vec_id) FILTER (WHERE e.label = d.doc_id % 5 AND len(e.embedding) = 64) AS completed, count(*) FILTER (WHERE e.vec_id IS NULL) AS pending, count(*) FILTER (WHERE e.vec_id IS NOT NULL AND e.label <> d.doc_id % 5) AS stale FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id")
def progress_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    d, e = tables(spark, sf, "documents", "embeddings")
    j = d.select("doc_id").join(e.select("vec_id", "label", F.size("embedding").alias("dim")), F.col("doc_id") == F.col("vec_id"), "left")
    right = F.col("label") == F.col("doc_id") % 5
    return j.agg(F.count_distinct("doc_id").alias("total"), F.count_distinct(F.when(right & (F.col("dim") == 64), F.col("vec_id"))).alias("completed"), R.count_where(F.col("vec_id").isNull()).alias("pending"), R.count_where(~right).alias("stale"))


@query("config_fingerprint", "SELECT r_regionkey, 'cfg_' || substr(sha256(concat_ws(chr(31), r_name, '64', 'cosine')), 1, 32) AS fingerprint FROM region")
def config_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    digest = F.sha2(F.concat_ws("\x1f", "r_name", F.lit("64"), F.lit("cosine")).cast("binary"), 256)
    return table(spark, sf, "region").select("r_regionkey", F.concat(F.lit("cfg_"), F.substring(digest, 1, 32)).alias("fingerprint"))


@query("sampling_policy", "SELECT lang, count(*) AS n, CASE WHEN count(*) > 100 THEN 64 ELSE count(*) END AS sampled FROM documents GROUP BY 1")
def sampling_policy(spark: SparkSession, sf: str) -> DataFrame:
    n = F.count(F.lit(1))
    return table(spark, sf, "documents").groupBy("lang").agg(n.alias("n"), F.when(n > 100, 64).otherwise(n).alias("sampled"))


# change detection

KNOWN = "known AS (SELECT 'o/' || o_orderkey AS path, o_orderpriority AS etag, o_orderdate AS mtime, o_totalprice AS size, CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END AS misses, CASE WHEN o_orderkey % 8 = 0 THEN TIMESTAMP '2024-01-29 00:00:00' WHEN o_orderkey % 4 = 0 THEN TIMESTAMP '2024-01-30 12:00:00' END AS missing_since FROM orders WHERE o_orderkey % 5 <> 0)"
REMOTE = "remote AS (SELECT 'o/' || o_orderkey AS path, o_orderpriority AS etag, o_orderdate AS mtime, o_totalprice + CASE WHEN o_orderkey % 9 = 0 THEN 1 ELSE 0 END AS size FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 16 <> 0)"
STATES = f"""WITH {KNOWN}, {REMOTE}, j AS (SELECT coalesce(k.path, r.path) AS path, k.path AS kp, r.path AS rp, CASE WHEN r.path IS NULL THEN k.misses + 1 ELSE 0 END AS misses, k.misses AS before,
  coalesce(k.missing_since, {NOW}) <= {NOW} - INTERVAL 24 HOUR AS overdue, k.etag IS NOT DISTINCT FROM r.etag AND k.mtime IS NOT DISTINCT FROM r.mtime AND k.size IS NOT DISTINCT FROM r.size AS same FROM known k FULL JOIN remote r ON k.path = r.path),
s AS (SELECT path, misses, CASE WHEN kp IS NULL THEN 'discovered' WHEN rp IS NULL AND misses >= 2 AND overdue THEN 'missing' WHEN rp IS NULL THEN 'suspected_missing' WHEN before > 0 THEN 'restored' WHEN same THEN 'unchanged' ELSE 'changed' END AS state FROM j)
"""


def scan_states(spark: SparkSession, sf: str) -> DataFrame:
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    base = [F.concat(F.lit("o/"), k.cast("string")).alias("path"), F.col("o_orderpriority").alias("etag"), F.col("o_orderdate").alias("mtime")]
    at = lambda x: F.lit(x).cast("timestamp")
    known = o.where(k % 5 != 0).select(*base, F.col("o_totalprice").alias("size"), F.when(k % 4 == 0, 1).otherwise(0).alias("misses"), F.when(k % 8 == 0, at("2024-01-29 00:00:00")).when(k % 4 == 0, at("2024-01-30 12:00:00")).alias("missing_since"))
    remote = o.where((k % 7 != 0) & (k % 16 != 0)).select(*base, (F.col("o_totalprice") + F.when(k % 9 == 0, 1).otherwise(0)).alias("size"))
    return R.reconcile(known, remote, now())


@query("reconcile_scan", STATES + "SELECT path, state, misses FROM s")
def reconcile_scan(spark: SparkSession, sf: str) -> DataFrame:
    return scan_states(spark, sf)


@query("scan_counters", STATES + "SELECT state, count(*) AS n FROM s GROUP BY 1")
def scan_counters(spark: SparkSession, sf: str) -> DataFrame:
    return scan_states(spark, sf).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("missing_confirmation", STATES + "SELECT path FROM s WHERE state = 'missing'")
def missing_confirmation(spark: SparkSession, sf: str) -> DataFrame:
    return scan_states(spark, sf).where("state = 'missing'").select("path")


ENTRIES = "WITH e AS (SELECT r_name || '/' || n_name || '/' || c_name AS path, c_acctbal < 0 AS failed FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name || '/' || r_name || '.txt', false FROM region)\n"


@query("browse_entries", ENTRIES + """, u AS (SELECT substr(path, 6) AS rest, failed FROM e WHERE starts_with(path, 'ASIA/'))
SELECT split_part(rest, '/', 1) AS name, 'folder' AS kind, count(*) AS n, count(*) FILTER (WHERE failed) AS n_failed FROM u WHERE contains(rest, '/') GROUP BY 1 UNION ALL SELECT rest, 'file', 1, CAST(failed AS BIGINT) FROM u WHERE NOT contains(rest, '/')""")
def browse_entries(spark: SparkSession, sf: str) -> DataFrame:
    c, n, r = tables(spark, sf, "customer", "nation", "region")
    e = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat_ws("/", "r_name", "n_name", "c_name").alias("path"), (F.col("c_acctbal") < 0).alias("failed"))
    return R.browse(e.union(r.select(F.concat("r_name", F.lit("/"), "r_name", F.lit(".txt")), F.lit(False))), "ASIA/")


@query("freshness", f"""SELECT user_id, CASE WHEN user_id % 10 = 0 THEN 'not_applicable' WHEN user_id % 7 = 0 OR greatest(date_diff('minute', max(ts), {NOW}), 0) >= 60 + user_id THEN 'stale' ELSE 'fresh' END AS state FROM events GROUP BY 1""")
def freshness(spark: SparkSession, sf: str) -> DataFrame:
    last = table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("ts"))
    # whole minutes between the two minutes, as a clock shows them
    age = (F.unix_timestamp(now()) - F.unix_timestamp(F.date_trunc("minute", "ts"))) / 60
    interval, error = F.when(F.col("user_id") % 10 != 0, 60 + F.col("user_id")), F.when(F.col("user_id") % 7 == 0, "failed")
    return last.select("user_id", R.freshness(age.cast("long"), interval, error).alias("state"))


@query("schedule_refresh", "SELECT DISTINCT 'db-refresh:' || user_id || ':' || CAST(floor(epoch(ts) / 3600) AS BIGINT) AS key FROM events WHERE event_type = 'error'")
def schedule_refresh(spark: SparkSession, sf: str) -> DataFrame:
    hour = F.floor(F.unix_timestamp("ts") / 3600).cast("string")
    return table(spark, sf, "events").where("event_type = 'error'").select(F.concat(F.lit("db-refresh:"), F.col("user_id").cast("string"), F.lit(":"), hour).alias("key")).dropDuplicates(["key"])


@query("snapshot_fingerprint", """WITH d AS (SELECT sha256('["' || o_orderkey || '","' || o_orderstatus || '","' || o_orderpriority || '"]') AS h FROM orders)
SELECT sha256('o_orderkey,o_orderstatus,o_orderpriority|' || count(*) || '|' || """ + " || ':' || ".join(f"CAST(sum(CAST(CAST('0x' || substr(h, {k}, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR)" for k in (1, 16, 31, 46)) + """) AS fingerprint FROM d""")
def snapshot_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    """A digest of the columns, the number of rows and four sums over the digests of the rows: it does not depend on their order, and its state has one size whatever the table has."""
    names = ["o_orderkey", "o_orderstatus", "o_orderpriority"]
    rows = table(spark, sf, "orders").select(F.sha2(F.to_json(F.array(*[F.col(c).cast("string") for c in names])).cast("binary"), 256).alias("h"))
    sums = [F.sum(F.conv(F.substring("h", k, 15), 16, 10).cast("decimal(38,0)")).cast("string") for k in (1, 16, 31, 46)]
    return rows.agg(F.sha2(F.concat(F.lit(",".join(names) + "|"), F.count(F.lit(1)).cast("string"), F.lit("|"), F.concat_ws(":", *sums)).cast("binary"), 256).alias("fingerprint"))


@query("fingerprint_by_sums", "SELECT count(*) AS n, CAST(sum(o_orderkey % 1000003) AS BIGINT) AS keys, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders")
def fingerprint_by_sums(spark: SparkSession, sf: str) -> DataFrame:
    """An order-free fingerprint whose state has one size whatever the table has."""
    return table(spark, sf, "orders").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("o_orderkey") % 1000003).alias("keys"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))


@query("blob_dedup", "SELECT sha256(text) AS sha, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1")
def blob_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("sha")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


# monitoring


@query("knowledge_counts", "SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM labels) AS links, (SELECT count(*) FROM embeddings) AS vectors, (SELECT count(*) FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id WHERE e.label = d.doc_id % 5) AS active_vectors")
def knowledge_counts(spark: SparkSession, sf: str) -> DataFrame:
    d, l, e = tables(spark, sf, "documents", "labels", "embeddings")
    n = lambda f, name: f.agg(F.count(F.lit(1)).alias(name))
    active = e.join(d.select("doc_id"), F.col("doc_id") == F.col("vec_id")).agg(R.count_where(F.col("label") == F.col("doc_id") % 5).alias("active_vectors"))
    one = F.lit(True)
    return n(d, "documents").join(n(l, "links"), one).join(n(e, "vectors"), one).join(active, one)


@query("queue_counts", "SELECT event_type AS status, count(*) AS n, min(ts) AS oldest FROM events GROUP BY 1")
def queue_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("oldest"))


@query("capacity", "SELECT CASE WHEN EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) THEN 'original' WHEN EXISTS (SELECT 1 FROM benchmark b WHERE b.item_id = d.doc_id) THEN 'preview' ELSE 'other' END AS kind, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents d GROUP BY 1")
def capacity(spark: SparkSession, sf: str) -> DataFrame:
    d, l, b = tables(spark, sf, "documents", "labels", "benchmark")
    flagged = d.select("doc_id", "n_chars").join(l.select("doc_id").distinct().withColumn("o", F.lit(1)), "doc_id", "left").join(b.select(F.col("item_id").alias("doc_id")).distinct().withColumn("p", F.lit(1)), "doc_id", "left")
    kind = F.when(F.col("o").isNotNull(), "original").when(F.col("p").isNotNull(), "preview").otherwise("other")
    return flagged.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("bytes"))


@query("hourly_history", "SELECT date_trunc('hour', ts) AS hour, event_type AS metric, arg_max(value, (ts, event_id)) AS value FROM events WHERE ts >= TIMESTAMP '2024-01-11 00:00:00' GROUP BY 1, 2")
def hourly_history(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("ts", F.col("event_type").alias("metric"), "value", F.col("event_id").alias("id"))
    return R.hourly(e, now(), 20)


@query("metric_state", f"SELECT event_type AS metric, CASE WHEN date_diff('minute', max(ts), {NOW}) > 180 THEN 'stale' WHEN arg_max(value, (ts, event_id)) > 50 THEN 'degraded' ELSE 'ok' END AS state FROM events GROUP BY 1")
def metric_state(spark: SparkSession, sf: str) -> DataFrame:
    last = table(spark, sf, "events").groupBy(F.col("event_type").alias("metric")).agg(F.max("ts").alias("ts"), F.max_by("value", F.struct("ts", "event_id")).alias("v"))
    age = (F.unix_timestamp(now()) - F.unix_timestamp(F.date_trunc("minute", "ts"))) / 60
    return last.select("metric", F.when(age > 180, "stale").when(F.col("v") > 50, "degraded").otherwise("ok").alias("state"))


@query("backoff", "SELECT user_id, CAST(least(3600, 60 * pow(2, least(count(*) FILTER (WHERE event_type = 'error'), 8))) AS BIGINT) AS seconds FROM events GROUP BY 1")
def backoff(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "events").groupBy("user_id").agg(R.count_where(F.col("event_type") == "error").alias("n"))
    return n.select("user_id", R.backoff_seconds(F.col("n")).alias("seconds"))


# queues


@query("claim_due", "SELECT event_id FROM events WHERE event_type IN ('signup', 'click') AND (value IS NULL OR value <= 30) ORDER BY ts, event_id LIMIT 25")
def claim_due(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").where(F.col("event_type").isin("signup", "click") & (F.col("value").isNull() | (F.col("value") <= 30)))
    return e.orderBy("ts", "event_id").select("event_id").limit(25)


@query("stage_fair_scheduler", "WITH t AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS turn FROM events) SELECT event_id, event_type, turn FROM t ORDER BY turn, event_type LIMIT 33")
def stage_fair_scheduler(spark: SparkSession, sf: str) -> DataFrame:
    return R.fair_order(table(spark, sf, "events"), "event_type", ["ts", "event_id"], 33).orderBy("turn", "event_type").select("event_id", "event_type", F.col("turn").cast("long").alias("turn")).limit(33)


@query("busy_document_exclusion", "SELECT event_id FROM events e WHERE event_type = 'click' AND NOT EXISTS (SELECT 1 FROM events b WHERE b.user_id = e.user_id AND b.event_type = 'error' AND b.value > 90)")
def busy_document_exclusion(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.where("event_type = 'click'").join(e.where("event_type = 'error' AND value > 90").select("user_id"), "user_id", "left_anti").select("event_id")


@query("retry_backoff", "SELECT event_id, ts + (5 * CAST(pow(2, event_id % 3) AS INTEGER)) * INTERVAL 1 MINUTE AS next_at FROM events WHERE event_type = 'error'")
def retry_backoff(spark: SparkSession, sf: str) -> DataFrame:
    wait = (5 * F.pow(F.lit(2), F.col("event_id") % 3)).cast("int")
    return table(spark, sf, "events").where("event_type = 'error'").select("event_id", (F.col("ts") + F.make_dt_interval(mins=wait)).alias("next_at"))


@query("lease_gaps", "WITH g AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events) SELECT user_id, count(*) FILTER (WHERE gap IS NULL OR gap > INTERVAL 6 HOUR) AS sessions FROM g GROUP BY 1")
def lease_gaps(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.col("ts") - F.lag("ts").over(w)
    g = table(spark, sf, "events").select("user_id", (gap.isNull() | (gap > F.make_dt_interval(hours=F.lit(6)))).alias("new"))
    return g.groupBy("user_id").agg(R.count_where(F.col("new")).alias("sessions"))


@query("idempotent_enqueue", "SELECT event_type || ':' || user_id AS key, min(event_id) AS event_id FROM events GROUP BY 1")
def idempotent_enqueue(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy(F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("key")).agg(F.min("event_id").alias("event_id"))


@query("priority_weighted_cycle", "WITH p AS (SELECT event_id, event_type = 'signup' AS fore, row_number() OVER (PARTITION BY event_type = 'signup' ORDER BY ts, event_id) - 1 AS n FROM events WHERE event_type IN ('signup', 'view')) SELECT event_id FROM p ORDER BY CASE WHEN fore THEN n // 4 * 5 + n % 4 ELSE n * 5 + 4 END LIMIT 50")
def priority_weighted_cycle(spark: SparkSession, sf: str) -> DataFrame:
    """Four of the foreground, then one of the history."""
    e = table(spark, sf, "events").where(F.col("event_type").isin("signup", "view")).withColumn("fore", F.col("event_type") == "signup")
    n = F.row_number().over(Window.partitionBy("fore").orderBy("ts", "event_id")) - 1
    e = e.withColumn("n", n).where("n < 50")  # 50 of each are enough, and a limit of a group is applied before the shuffle
    return e.orderBy(F.when(F.col("fore"), F.floor(F.col("n") / 4) * 5 + F.col("n") % 4).otherwise(F.col("n") * 5 + 4)).select("event_id").limit(50)


@query("rechunk_enqueue", "SELECT doc_id FROM documents d WHERE n_chars > 500 AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AND NOT EXISTS (SELECT 1 FROM benchmark b WHERE b.item_id = d.doc_id) ORDER BY doc_id LIMIT 20")
def rechunk_enqueue(spark: SparkSession, sf: str) -> DataFrame:
    d, l, b = tables(spark, sf, "documents", "labels", "benchmark")
    return d.where("n_chars > 500").join(l, "doc_id", "left_anti").join(b.select(F.col("item_id").alias("doc_id")), "doc_id", "left_anti").orderBy("doc_id").select("doc_id").limit(20)


# summary trees


@query("plan_hierarchy", "WITH n AS (SELECT ceil((SELECT count(*) FROM benchmark) / 1.0) AS n) SELECT level, i AS ordinal, CAST(i * pow(4, level) AS BIGINT) AS first, CAST(least(n, (i + 1) * pow(4, level)) - 1 AS BIGINT) AS last FROM n, range(1, 4) l(level), range(0, 40) r(i) WHERE i < ceil(n / pow(4, level)) AND (level = 1 OR ceil(n / pow(4, level - 1)) > 1)")
def plan_hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "benchmark").count()
    return spark.createDataFrame(R.hierarchy(n), "level long, ordinal long, first long, last long")


@query("entity_candidates", r"WITH w AS (SELECT DISTINCT conv_id, unnest(regexp_extract_all(lower(text), '[\p{L}]{6,}')) AS label FROM conversations) SELECT label, count(*) AS n FROM w GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, label LIMIT 20")
def entity_candidates(spark: SparkSession, sf: str) -> DataFrame:
    w = table(spark, sf, "conversations").select("conv_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}{6,})"), F.lit(1))).alias("label")).distinct()
    return w.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), "label").limit(20)


@query("enhancement_progress", "SELECT role AS status, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY 1")
def enhancement_progress(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").groupBy(F.col("role").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
