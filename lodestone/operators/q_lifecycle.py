"""Queries of reads, vector upkeep, candidates, stage chains and answer envelopes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone import store
from lodestone.catalog import table
from lodestone.operators import chunking, evidence
from lodestone.operators import relations as R
from lodestone.operators.q_documents import BLOCKS, documents
from lodestone.operators.q_plan import DATASET, FIELDS, dataset
from lodestone.operators.registry import query
from lodestone.plans import compiler, units
from lodestone.plans.model import Field, validate
from lodestone.sources import snapshots


def _labelled(spark: SparkSession, sf: str, condition: str) -> DataFrame:
    return table(spark, sf, "labels").where(condition).select(F.col("doc_id").alias("document_id")).distinct()


@query("read_document", "SELECT doc_id AS document_id, text, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def read_document(spark: SparkSession, sf: str) -> DataFrame:
    """Reads the documents asked for (those of good quality) that are visible (not toxic)."""
    wanted = documents(spark, sf).join(_labelled(spark, sf, "quality = 1"), "document_id", "left_semi")
    return R.visible(wanted, _labelled(spark, sf, "toxic = 1")).select("document_id", "text", "n_chars")


@query("vector_repair", "SELECT 'embed:' || doc_id AS key, CASE WHEN vec_id IS NULL THEN 'missing' ELSE 'dimension' END AS reason FROM documents LEFT JOIN embeddings ON vec_id = doc_id WHERE (vec_id IS NULL OR len(embedding) <> 64) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def vector_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs for the visible documents whose vector is missing or of another dimension."""
    live = R.visible(documents(spark, sf), _labelled(spark, sf, "toxic = 1"))
    vectors = table(spark, sf, "embeddings").withColumnRenamed("vec_id", "document_id")
    return R.missing_vectors(live, vectors, 64).select(F.concat(F.lit("embed:"), F.col("document_id").cast("string")).alias("key"), "reason")


@query("split_table_text", """WITH r AS (SELECT c_custkey AS n, '行 ' || c_custkey || '｜name=' || c_name || '｜segment=' || c_mktsegment AS line FROM customer), f AS (SELECT n, line, unnest(range(0, CAST(ceil(length(line) / 30) AS BIGINT))) AS i, CAST(ceil(length(line) / 30) AS BIGINT) AS k FROM r)
SELECT n, i + 1 AS part, CASE WHEN k = 1 THEN line ELSE '行 ' || n || '｜【片段 ' || (i + 1) || '/' || k || '】' || substr(line, i * 30 + 1, 30) END AS text FROM f""")
def split_table_text(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a table as lines; one that is too long is cut, and each part says of which row it is."""
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("n"), F.concat(F.lit("行 "), F.col("c_custkey").cast("string"), F.lit("｜name="), "c_name", F.lit("｜segment="), "c_mktsegment").alias("line"))
    return chunking.row_parts(rows, 30)


@query("qa_timing", "SELECT user_id AS request, event_type AS stage, round(sum(value), 6) AS ms, count(*) AS n FROM events GROUP BY 1, 2")
def qa_timing(spark: SparkSession, sf: str) -> DataFrame:
    """Accumulated time of each stage of a request."""
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("request"), F.col("event_type").alias("stage")).agg(F.round(F.sum("value"), 6).alias("ms"), F.count(F.lit(1)).alias("n"))


STAGES = ["view", "click", "signup", "purchase", "error"]


@query("pipeline_dag", "WITH d AS (SELECT user_id AS document_id, list(DISTINCT event_type) AS done FROM events WHERE value > 50 GROUP BY 1) SELECT document_id, list_filter(['view', 'click', 'signup', 'purchase', 'error'], lambda s: NOT list_contains(done, s))[1] AS next FROM d")
def pipeline_dag(spark: SparkSession, sf: str) -> DataFrame:
    """The stage that each document waits for: the first of the chain that has no success."""
    done = table(spark, sf, "events").where("value > 50").groupBy(F.col("user_id").alias("document_id")).agg(F.collect_set("event_type").alias("done"))
    return done.select("document_id", R.next_stage(F.col("done"), STAGES).alias("next"))


@query("profile_state_machine", "SELECT d.lang AS profile, CASE WHEN count(*) > count(e.vec_id) THEN 'building' ELSE 'active' END AS state FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id GROUP BY 1")
def profile_state_machine(spark: SparkSession, sf: str) -> DataFrame:
    """Each ready profile is asked to become active, and goes back to building where its vectors are not complete."""
    lacks = R.missing_vectors(documents(spark, sf), table(spark, sf, "embeddings").withColumnRenamed("vec_id", "document_id"), 64)
    n = documents(spark, sf).join(lacks.where("reason = 'missing'"), "document_id", "left").groupBy("lang").agg(F.count("reason").alias("missing")).collect()  # a row per profile
    return spark.createDataFrame([(r["lang"], evidence.next_profile_state("ready", "active", r["missing"])) for r in n], "profile string, state string")


VARIANTS = ["same", "scaled", "next", "model", "none"]


@query("compatibility_judge", """WITH r AS (SELECT label, CAST(embedding AS DOUBLE[]) AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS place FROM embeddings), c AS (SELECT * FROM r WHERE place <= 3),
l AS (SELECT DISTINCT label FROM c), v AS (SELECT label, unnest(['same', 'scaled', 'next', 'model', 'none']) AS variant FROM l),
s AS (SELECT a.label, 'scaled' AS variant, list_cosine_similarity(a.e, list_transform(a.e, lambda x: 2 * x)) AS s FROM c a UNION ALL SELECT a.label, 'next', list_cosine_similarity(a.e, b.e) FROM c a JOIN c b ON b.label = a.label + 1 AND b.place = a.place
  UNION ALL SELECT label, unnest(['same', 'model']), 1.0 FROM c),
m AS (SELECT label, variant, min(s) AS s FROM s GROUP BY 1, 2)
SELECT label, variant, CASE WHEN variant = 'same' THEN 'same' WHEN variant = 'model' THEN 'rebuild_required' WHEN s IS NULL THEN 'unknown' WHEN s >= 0.999 THEN 'compatible' ELSE 'rebuild_required' END AS verdict FROM v LEFT JOIN m USING (label, variant)""")
def compatibility_judge(spark: SparkSession, sf: str) -> DataFrame:
    """Whether vectors of another profile may stand beside those of a label, by three canaries: the same profile, one that gives vectors of twice the length, the next label's, one of another model,
    and one without canaries."""
    place = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))  # limited in each task before the shuffle
    canaries = table(spark, sf, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("e"), place.alias("place")).where("place <= 3")
    variants = F.array(*[F.lit(v) for v in VARIANTS])
    profiles = canaries.select("label").distinct().select("label", F.explode(variants).alias("variant"))
    own = canaries.select("label", F.explode(F.array(F.lit("same"), F.lit("scaled"), F.lit("model"))).alias("variant"), "e", F.when(F.col("variant") == "scaled", F.transform("e", lambda x: 2 * x)).otherwise(F.col("e")).alias("other"))
    after = canaries.select((F.col("label") - 1).alias("label"), "place", F.col("e").alias("other"))
    pairs = own.unionByName(canaries.join(after, ["label", "place"]).select("label", F.lit("next").alias("variant"), "e", "other"))
    judged = evidence.compatibility(pairs, profiles.withColumns({"same_fingerprint": F.col("variant") == "same", "same_shape": F.col("variant") != "model"}), ["label", "variant"])
    return judged.select("label", "variant", "verdict")


@query("aggregate_withholding", DATASET + "SELECT 'blocked' AS verdict, CAST(0 AS BIGINT) AS n_rows, count(*) AS matched_rows FROM typed")
def aggregate_withholding(spark: SparkSession, sf: str) -> DataFrame:
    """A sum over amounts of different units keeps its counts and gives no rows."""
    fields = [Field("amount", "number"), Field("unit")]
    rows = dataset(spark, sf).select("row_number", "amount", F.col("segment").alias("unit"))
    plan = validate({"metric": "sum", "metric_column": "amount"}, fields)
    stats = [units.UnitStats(r["unit_column"], r["n_units"], r["n_blank"], tuple(r["units"].split("|"))) for r in compiler.unit_stats(rows, plan, fields, ["unit"]).collect()]  # a row per unit column
    matched = compiler.matched_stats(rows, plan, fields).first()["matched"]
    verdict = units.verdict(plan, matched, ["unit"], stats)
    answer = units.withheld(verdict, compiler.compile_plan(rows, plan, fields).collect(), matched)  # a page of the plan
    return spark.createDataFrame([(verdict, len(answer["rows"]), answer["matched_rows"])], "verdict string, n_rows long, matched_rows long")


@query("plan_echo", "SELECT 'sum' AS metric, 'amount' AS metric_column, 'segment' AS group_by, 20 AS \"limit\", count(*) AS source_rows FROM customer")
def plan_echo(spark: SparkSession, sf: str) -> DataFrame:
    """The plan as validated, with the size of what it reads."""
    echo = validate({"metric": "sum", "metric_column": "amount", "group_by": ["segment"], "limit": 20}, FIELDS).echo()
    said = [F.lit(echo["metric"]).alias("metric"), F.lit(echo["metric_column"]).alias("metric_column"), F.lit(",".join(echo["group_by"])).alias("group_by"), F.lit(echo["limit"]).alias("limit")]
    return dataset(spark, sf).agg(F.count(F.lit(1)).alias("source_rows")).select(*said, "source_rows")


@query("split_source_spans", r"""WITH RECURSIVE t AS (SELECT doc_id AS document_id, text, length(text) AS n, 0 AS "begin", 0 AS "end", -1 AS span FROM documents
UNION ALL SELECT document_id, text, n, "end", "end" + CASE WHEN n - "end" <= 600 THEN n - "end" WHEN length(regexp_extract(w, '(?s)^.*\n')) > 300 THEN length(regexp_extract(w, '(?s)^.*\n')) WHEN length(regexp_extract(w, '(?s)^.*[.!?。！？]')) > 300 THEN length(regexp_extract(w, '(?s)^.*[.!?。！？]')) ELSE 600 END, span + 1
  FROM (SELECT *, substr(text, "end" + 1, 600) AS w FROM t WHERE "end" < n)) SELECT document_id, CAST(span AS BIGINT) AS span, CAST("begin" AS BIGINT) AS "begin", CAST("end" AS BIGINT) AS "end" FROM t WHERE span >= 0""")
def split_source_spans(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.source_spans(documents(spark, sf))


QUALITY = """, p AS (SELECT document_id, count(*) AS n, count(*) FILTER (WHERE length(text) < 80) AS n_short, count(*) - count(DISTINCT text) AS n_repeated FROM blocks GROUP BY 1),
q AS (SELECT document_id, 100 - CAST(round_even(45.0 * n_short / n, 0) AS BIGINT) - least(2 * n_repeated, 20) < 60 AS fallback FROM p)"""


@query("page_safe_fallback", BLOCKS + QUALITY + " SELECT document_id, place, CASE WHEN fallback AND kind = 'heading' THEN 'paragraph' ELSE kind END AS kind FROM blocks JOIN q USING (document_id)")
def page_safe_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """The blocks of documents with low chunk quality, without headings."""
    blocks = chunking.blocks(documents(spark, sf))
    return chunking.page_safe(blocks, chunking.chunk_quality(blocks.withColumnRenamed("text", "content"))).select("document_id", "place", "kind")


@query("output_validate", """SELECT event_id, CASE WHEN NOT json_valid(props) THEN 'not_json' WHEN json_keys(props) = ['k'] AND json_type(props, '$.k') IN ('UBIGINT', 'BIGINT') THEN 'ok' ELSE 'wrong_shape' END AS whole,
CASE WHEN json_valid('{"stage":"' || event_type || '","props":' || props) THEN 'ok' ELSE 'not_json' END AS cut FROM events""")
def output_validate(spark: SparkSession, sf: str) -> DataFrame:
    """Outputs against their contract, whole and with the last brace lost."""
    cut = F.concat(F.lit('{"stage":"'), "event_type", F.lit('","props":'), "props")
    return table(spark, sf, "events").select("event_id", R.output_verdict(F.col("props"), "OBJECT<k: BIGINT>").alias("whole"), R.output_verdict(cut, "OBJECT<props: OBJECT<k: BIGINT>, stage: STRING>").alias("cut"))


@query("database_refresh", "SELECT * FROM (SELECT 1 AS step, 'published' AS outcome, count(*) AS n_rows FROM customer UNION ALL SELECT 2, 'kept', count(*) FROM customer UNION ALL SELECT 3, 'published', count(*) FROM supplier)")
def database_refresh(spark: SparkSession, sf: str) -> DataFrame:
    """Imports of a table, the second of which comes back empty."""
    root = store.new_path(spark, "refreshed")
    customer, supplier = (table(spark, sf, name).select(F.col(f"{name[0]}_name").alias("name")) for name in ("customer", "supplier"))
    out = [(k, snapshots.refresh(rows, root), snapshots.active(spark, root).count()) for k, rows in enumerate((customer, customer.limit(0), supplier), 1)]
    return spark.createDataFrame(out, "step int, outcome string, n_rows long")
