"""Queries over what callers send: plans, questions, names, described fields and sizes, all made of the tables' rows."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.catalog import table
from lodestone.functions import text as T
from lodestone.operators import evidence as E
from lodestone.operators import profile
from lodestone.operators.registry import query
from lodestone.plans.model import Field, PlanError, validate, validate_drafted

TABLES = ["customer", "documents", "events", "labels", "lineitem", "nation", "orders", "pages", "part", "supplier"]

#: An order's number in numerals, between words and single ideographs.
NUMERALS = "'order ' || translate(CAST(o_orderkey AS VARCHAR), '0123456789', '零一二三四五六七八九') || ' 号 ' || o_orderpriority"


@query("cjk_ngrams", f"""WITH q AS (SELECT o_orderkey, {NUMERALS} AS q FROM orders), r AS (SELECT o_orderkey, regexp_extract_all(q, '[一-鿿]+') AS runs FROM q),
s AS (SELECT o_orderkey, x, k, n FROM (SELECT o_orderkey, unnest(runs) AS x, generate_subscripts(runs, 1) AS k FROM r), (VALUES (3), (2)) t(n)),
g AS (SELECT o_orderkey, n, k, i, substr(x, CAST(i AS INT), n) AS gram FROM (SELECT *, unnest(range(1, length(x) - n + 2)) AS i FROM s WHERE length(x) >= n)),
f AS (SELECT o_orderkey, gram, row_number() OVER (PARTITION BY o_orderkey ORDER BY min((3 - n) * 1000000 + k * 1000 + i)) AS p FROM g GROUP BY 1, 2)
SELECT o.o_orderkey, coalesce(string_agg(gram, ',' ORDER BY p) FILTER (WHERE p <= 24), '') AS grams FROM orders o LEFT JOIN f USING (o_orderkey) GROUP BY 1""")
def cjk_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(T.cjk_grams(F.expr(NUMERALS.replace("VARCHAR", "STRING"))), ",").alias("grams"))


@query("weighted_patterns", f"""WITH q AS (SELECT o_orderkey, {NUMERALS} AS q FROM orders), w AS (SELECT o_orderkey, regexp_extract_all(lower(trim(q)), '[\\p{{L}}\\p{{N}}_]+') AS w, regexp_extract_all(q, '[一-鿿]+') AS runs FROM q),
t AS (SELECT o_orderkey, x AS pattern, 5 AS weight, min(k) AS p FROM (SELECT o_orderkey, substr(unnest(w), 1, 32) AS x, generate_subscripts(w, 1) AS k FROM w) WHERE NOT regexp_matches(x, '[一-鿿]') GROUP BY 1, 2),
g AS (SELECT o_orderkey, n, substr(x, CAST(i AS INT), n) AS pattern, min(k * 1000 + i) AS p FROM (SELECT o_orderkey, x, k, n, unnest(range(1, length(x) - n + 2)) AS i FROM (SELECT o_orderkey, unnest(runs) AS x, generate_subscripts(runs, 1) AS k FROM w), (VALUES (3), (2)) v(n) WHERE length(x) >= n) GROUP BY ALL),
h AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey, n ORDER BY p) AS r FROM g),
a AS (SELECT o_orderkey, pattern, weight, p AS o FROM t UNION ALL SELECT o_orderkey, pattern, n - 1, (4 - n) * 1000000 + r FROM h WHERE r <= 12),
b AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY o) AS place FROM a) SELECT o_orderkey, pattern, CAST(weight AS INT) AS weight FROM b WHERE place <= 16""".replace("GROUP BY ALL)", "GROUP BY o_orderkey, n, pattern)").replace("substr(x, CAST(i AS INT), n) AS pattern, min", "substr(x, CAST(i AS INT), n) AS pattern, min"))
def weighted_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """What an order's label is searched by: its words, then its grams of three and of two ideographs, sixteen at most."""
    q = table(spark, sf, "orders").select("o_orderkey", F.expr(NUMERALS.replace("VARCHAR", "STRING")).alias("q"))
    weighed = lambda of, w: F.transform(of, lambda x: F.struct(x.alias("pattern"), F.lit(w).alias("weight")))
    terms = F.filter(T.query_terms(F.col("q")), lambda t: ~t.rlike(T.CJK))
    found = F.concat(weighed(terms, 5), *[weighed(T.cjk_grams(F.col("q"), (n,), 12), n - 1) for n in (3, 2)])
    return q.select("o_orderkey", F.inline(F.slice(found, 1, 16)))


@query("semantic_role", "WITH n AS (SELECT table_name AS \"table\", column_name AS name FROM information_schema.columns WHERE table_name IN (" + ", ".join(f"'{t}'" for t in TABLES) + ")) SELECT \"table\", name, CASE " + " ".join(f"WHEN regexp_matches(lower(name), '{pattern}') THEN '{role}'" for role, pattern in profile.ROLES) + " END AS role FROM n")
def semantic_role(spark: SparkSession, sf: str) -> DataFrame:
    """The roles that the names of all columns of the tables say."""
    names = [(t, f.name) for t in TABLES for f in table(spark, sf, t).schema.fields]
    return spark.createDataFrame(names, "table string, name string").select("table", "name", profile.semantic_role(F.col("name")).alias("role"))


@query("semantics_reuse", """WITH f AS (SELECT p_partkey % 2 AS version, p_brand AS name, min(p_type) AS kind, max(p_name) AS about FROM part GROUP BY 1, 2)
SELECT n.name, n.kind, coalesce(o.about, '') AS about, o.about IS NULL AS ask FROM f n LEFT JOIN f o ON o.version = 1 AND o.name = n.name AND o.kind = n.kind WHERE n.version = 0""")
def semantics_reuse(spark: SparkSession, sf: str) -> DataFrame:
    """Fields of a new version keep what was said of the old version's field of the same name and kind; of the others it is asked."""
    f = table(spark, sf, "part").groupBy((F.col("p_partkey") % 2).alias("version"), F.col("p_brand").alias("name")).agg(F.min("p_type").alias("kind"), F.max("p_name").alias("about"))
    old, new = f.where("version = 1").select("name", "kind", "about"), f.where("version = 0").select("name", "kind")
    return new.join(old, ["name", "kind"], "left").select("name", "kind", F.coalesce("about", F.lit("")).alias("about"), F.col("about").isNull().alias("ask"))


KNOWN = ["click", "error", "view", "signup"]


@query("field_semantics_validate", """WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type AS name, ' ' || props || ' ' AS about, CASE WHEN event_type = 'error' THEN -value ELSE value / 100 END AS confidence, count(*) OVER (PARTITION BY user_id, CAST(ts AS DATE), event_type) AS n FROM events)
SELECT user_id, CAST(day AS VARCHAR) AS day, name, trim(about) AS about, least(1.0, greatest(0.0, confidence)) AS confidence FROM e WHERE n = 1 AND name IN ('click', 'error', 'view', 'signup')""")
def field_semantics_validate(spark: SparkSession, sf: str) -> DataFrame:
    """The fields that a user's answer of a day describes, as JSON: kept are known names that the answer has once, with trimmed and cut texts and a confidence from 0 to 1."""
    e = table(spark, sf, "events")
    confidence = F.when(F.col("event_type") == "error", -F.col("value")).otherwise(F.col("value") / 100)
    said = F.struct(F.col("event_type").alias("name"), F.concat(F.lit(" "), "props", F.lit(" ")).alias("about"), confidence.alias("confidence"))
    answers = e.groupBy("user_id", F.to_date("ts").cast("string").alias("day")).agg(F.to_json(F.collect_list(said)).alias("answer"))
    rows = answers.select("user_id", "day", F.inline(F.from_json("answer", "array<struct<name:string,about:string,confidence:double>>")))
    once = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("user_id", "day", "name"))).where((F.col("n") == 1) & F.col("name").isin(KNOWN))
    return once.select("user_id", "day", "name", F.substring(F.trim(F.coalesce("about", F.lit(""))), 1, 500).alias("about"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("confidence", F.lit(0.0)))).alias("confidence"))


@query("evidence_budget", """WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS i, coalesce(length(text), 0) AS n, count(*) OVER (PARTITION BY conv_id) AS m FROM conversations),
g AS (SELECT conv_id, i, m, least(n, 4000 // m) AS given, 4000 - least(n, 4000 // m) AS room FROM t WHERE i = 1 UNION ALL SELECT t.conv_id, t.i, t.m, least(t.n, g.room // (t.m - t.i + 1)), g.room - least(t.n, g.room // (t.m - t.i + 1)) FROM g JOIN t ON t.conv_id = g.conv_id AND t.i = g.i + 1)
SELECT conv_id, string_agg(CAST(given AS VARCHAR), ',' ORDER BY i) AS given FROM g GROUP BY 1""")
def evidence_budget(spark: SparkSession, sf: str) -> DataFrame:
    """What each turn of a conversation gets of 4,000 characters."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "text", F.coalesce(F.length("text"), F.lit(0)).alias("n"))))
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(turns.alias("t"))
    return rows.select("conv_id", F.array_join(E.fair_share(F.col("t.n"), 4000).cast("array<string>"), ",").alias("given"))


@query("canary_similarity", "SELECT CAST(a.vec_id AS VARCHAR) AS name, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def canary_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """How like the vector of a text is to what the same text gave before (here, the vector of the next id)."""
    e = table(spark, sf, "embeddings")
    again = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return E.canary_similarity(e.select("vec_id", F.col("embedding").alias("a")).join(again, "vec_id").withColumn("name", F.col("vec_id").cast("string")))


#: Plans that events ask for, as JSON: what is measured by the type, and the limit by the number in props.
PLANS = """'{"limit": ' || {k} * 30 || CASE event_type WHEN 'click' THEN ', "metric": "sum", "metric_column": "amount", "group_by": ["segment"]' WHEN 'view' THEN ', "metric": "sum"' WHEN 'error' THEN ', "filters": [{"column": "nope", "operator": "eq", "value": 1}]' WHEN 'signup' THEN ', "metric": "rows", "group_by": ["segment"]' ELSE ', "filters": [{"column": "segment", "operator": "contains", "value": "x"}], "sort_by": "amount"' END || '}'"""
PLAN_FIELDS = [Field("amount", "number"), Field("segment")]


@query("plan_validate", """SELECT event_id, CASE WHEN k * 30 BETWEEN 1 AND 200 AND event_type IN ('click', 'purchase') THEN 'ok' ELSE 'invalid_query' END AS outcome FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)""")
def plan_validate(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each plan is one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for raw in batch["raw"]:
                try:
                    validate(json.loads(raw), PLAN_FIELDS)
                    out.append("ok")
                except PlanError as error:
                    out.append(error.code)
            yield pd.DataFrame({"event_id": batch["event_id"], "outcome": out})

    plans = F.expr(PLANS.replace("{k}", "get_json_object(props, '$.k')"))
    return table(spark, sf, "events").select("event_id", plans.alias("raw")).mapInPandas(run, "event_id long, outcome string")


@query("plan_validate_nl", """SELECT event_id, CASE WHEN event_type = 'click' THEN 'sum' ELSE 'count' END AS metric, CASE WHEN event_type = 'view' THEN 'asc' ELSE 'desc' END AS sort_order, CAST(CASE WHEN k = 0 THEN 20 ELSE least(k, 50) END AS INT) AS "limit" FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)""")
def plan_validate_nl(spark: SparkSession, sf: str) -> DataFrame:
    """What a drafted plan, with nulls where nothing was said, is understood to be."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            echoes = [validate_drafted(json.loads(raw), PLAN_FIELDS).echo() for raw in batch["raw"]]
            yield pd.DataFrame({"event_id": batch["event_id"], "metric": [e["metric"] for e in echoes], "sort_order": [e["sort_order"] for e in echoes], "limit": pd.Series([e["limit"] for e in echoes], dtype="int32")})

    metric = F.when(F.col("event_type") == "click", '"sum", "metric_column": "amount"').otherwise("null")
    order = F.when(F.col("event_type") == "view", '"asc"').otherwise("null")
    k = F.get_json_object("props", "$.k")
    raw = F.concat(F.lit('{"limit": '), F.when(k == "0", "null").otherwise(k), F.lit(', "metric": '), metric, F.lit(', "sort_order": '), order, F.lit("}"))
    return table(spark, sf, "events").select("event_id", raw.alias("raw")).mapInPandas(run, "event_id long, metric string, sort_order string, limit int")
