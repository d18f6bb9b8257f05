"""Queries of evidence, dataset catalogs, lifecycle changes and question answering steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.catalog import table, tables
from lodestone.operators import evidence as E
from lodestone.operators import relations as R
from lodestone.operators import search
from lodestone.operators.q_documents import BLOCKS, documents
from lodestone.operators.q_search import CHUNKS, LEXICAL, SCORE, chunks, index, rankings, scored
from lodestone.operators.registry import query


@query("dataset_list", "SELECT c_custkey, c_name, n_name, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n_orders FROM customer c JOIN nation ON n_nationkey = c_nationkey ORDER BY c_custkey DESC LIMIT 200")
def dataset_list(spark: SparkSession, sf: str) -> DataFrame:
    c, n, o = tables(spark, sf, "customer", "nation", "orders")
    page = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).orderBy(F.desc("c_custkey")).limit(200).select("c_custkey", "c_name", "n_name")
    counts = o.join(F.broadcast(page.select("c_custkey")), F.col("o_custkey") == F.col("c_custkey"), "left_semi").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"))
    return page.join(counts, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "c_name", "n_name", F.coalesce("n_orders", F.lit(0)).alias("n_orders"))


@query("dataset_schema", "SELECT column_name AS name, column_name LIKE '%key' AS identifier FROM information_schema.columns WHERE table_name = 'lineitem'")
def dataset_schema(spark: SparkSession, sf: str) -> DataFrame:
    names = spark.createDataFrame([(f.name,) for f in table(spark, sf, "lineitem").schema.fields], "name string")
    return names.select("name", F.col("name").endswith("key").alias("identifier"))


@query("catalog_text", "SELECT n_regionkey, 'region ' || n_regionkey || chr(10) || string_agg(n_name, '; ' ORDER BY n_nationkey) AS about FROM nation GROUP BY 1")
def catalog_text(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]), "; ")
    rows = table(spark, sf, "nation").groupBy("n_regionkey").agg(names.alias("names"))
    return rows.select("n_regionkey", F.concat(F.lit("region "), F.col("n_regionkey").cast("string"), F.lit("\n"), "names").alias("about"))


@query("answer_completion", "SELECT DISTINCT n_name AS missing FROM nation WHERE NOT contains('NATION_1, NATION_3 and nation_7', n_name)")
def answer_completion(spark: SparkSession, sf: str) -> DataFrame:
    """Values of the identity column (most distinct, least numeric, shortest) that an answer leaves out."""
    nation = table(spark, sf, "nation")
    long = nation.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("cell")) for c in nation.columns])).alias("x")).select("x.*")
    stats = long.groupBy("name").agg((F.count_distinct("cell") / F.count(F.lit(1))).alias("distinct"), F.avg(F.col("cell").try_cast("double").isNull().cast("int")).alias("texts"), (-F.avg(F.length("cell"))).alias("short"))
    identity = stats.orderBy(F.desc("texts"), F.desc("distinct"), F.desc("short")).first()["name"]
    return nation.select(F.col(identity).alias("missing")).where(~F.contains(F.lit("NATION_1, NATION_3 and nation_7"), F.col("missing"))).distinct()


@query("qa_snippet", CHUNKS + "SELECT chunk_id, CASE WHEN length(content) <= 600 THEN content ELSE substr(content, greatest(1, instr(lower(content), 'that') - 80), 600) END AS snippet FROM chunks WHERE contains(lower(content), 'that')")
def qa_snippet(spark: SparkSession, sf: str) -> DataFrame:
    hits = chunks(spark, sf).where(search.matches_any(F.col("content"), ["that"]))
    at = F.greatest(F.lit(1), F.instr(F.lower("content"), "that") - 80)
    return hits.select("chunk_id", F.when(F.length("content") <= 600, F.col("content")).otherwise(F.substring("content", at, F.lit(600))).alias("snippet"))


@query("backfill_missing", "SELECT 'embed:' || doc_id AS key FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def backfill_missing(spark: SparkSession, sf: str) -> DataFrame:
    d, e = tables(spark, sf, "documents", "embeddings")
    return d.join(e.select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti").select(F.concat(F.lit("embed:"), F.col("doc_id").cast("string")).alias("key"))


@query("profile_counters", "SELECT label AS profile, count(*) AS total, count(*) FILTER (WHERE len(embedding) = 64) AS completed, count(*) FILTER (WHERE len(embedding) <> 64) AS failed FROM embeddings GROUP BY 1")
def profile_counters(spark: SparkSession, sf: str) -> DataFrame:
    right = F.size("embedding") == 64
    return table(spark, sf, "embeddings").groupBy(F.col("label").alias("profile")).agg(F.count(F.lit(1)).alias("total"), F.count_if(right).alias("completed"), F.count_if(~right).alias("failed"))


@query("vector_coverage", "SELECT d.lang, count(*) AS expected, count(e.vec_id) AS completed, count(*) - count(e.vec_id) AS missing FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id GROUP BY 1")
def vector_coverage(spark: SparkSession, sf: str) -> DataFrame:
    d, e = tables(spark, sf, "documents", "embeddings")
    j = d.select("doc_id", "lang").join(e.select("vec_id"), F.col("doc_id") == F.col("vec_id"), "left")
    return j.groupBy("lang").agg(F.count(F.lit(1)).alias("expected"), F.count("vec_id").alias("completed"), (F.count(F.lit(1)) - F.count("vec_id")).alias("missing"))


@query("neighbor_merge_overlap", None)
def neighbor_merge_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return E.merged_neighbours(chunks(spark, sf))


@query("anchor_truncate", "SELECT doc_id, CASE WHEN length(text) <= 400 THEN text ELSE (CASE WHEN b > 0 THEN '…' ELSE '' END) || substr(text, b + 1, 400) || (CASE WHEN b + 400 < length(text) THEN '…' ELSE '' END) END AS cut FROM (SELECT doc_id, text, greatest(0, least(instr(text, '.') - 200, length(text) - 400)) AS b FROM documents)")
def anchor_truncate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", E.centred(F.col("text"), F.instr("text", "."), 400).alias("cut"))


@query("evidence_classify", "SELECT page_id, CASE WHEN contains(html, '<table') THEN 'dataset' WHEN url LIKE '%.pdf%' THEN 'pdf_word' WHEN url LIKE '%.md%' THEN 'markdown' ELSE 'document' END AS kind FROM pages")
def evidence_classify(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", F.when(F.contains("html", F.lit("<table")), "dataset").when(u.contains(".pdf"), "pdf_word").when(u.contains(".md"), "markdown").otherwise("document").alias("kind"))


@query("evidence_resolve", "SELECT o_orderkey, CASE WHEN c.c_custkey IS NULL THEN 'missing' WHEN o_custkey % 3 <> c.c_custkey % 2 THEN 'version_mismatch' ELSE 'ok' END AS state FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 10 <> 0) c ON c.c_custkey = o_custkey")
def evidence_resolve(spark: SparkSession, sf: str) -> DataFrame:
    o, c = tables(spark, sf, "orders", "customer")
    cited = o.select("o_orderkey", "o_custkey", (F.col("o_custkey") % 3).alias("cited"))
    current = c.where("c_custkey % 10 <> 0").select("c_custkey", (F.col("c_custkey") % 2).alias("version"))
    state = F.when(F.col("version").isNull(), "missing").when(F.col("cited") != F.col("version"), "version_mismatch").otherwise("ok")
    return cited.join(current, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", state.alias("state"))


@query("citation_whitelist", """WITH x AS (SELECT l_orderkey, coalesce(list(l_linenumber ORDER BY l_linenumber) FILTER (WHERE l_returnflag = 'R'), []) AS cited, coalesce(list(l_linenumber) FILTER (WHERE l_linestatus = 'F'), []) AS known FROM lineitem GROUP BY 1),
y AS (SELECT l_orderkey, cited, list_filter(cited, lambda c: NOT list_contains(known, c)) AS unknown FROM x) SELECT l_orderkey, len(cited) > 0 AND len(unknown) = 0 AS supported, array_to_string(list_sort(list_distinct(unknown)), ',') AS unknown FROM y""")
def citation_whitelist(spark: SparkSession, sf: str) -> DataFrame:
    """An order's returned lines are what is cited, its finished lines what is known."""
    lines = lambda rule: F.array_sort(F.collect_set(F.when(F.expr(rule), F.col("l_linenumber").cast("string"))))
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(lines("l_returnflag = 'R'").alias("cited"), lines("l_linestatus = 'F'").alias("known"))
    left = E.uncited(F.col("cited"), F.col("known"))
    return rows.select("l_orderkey", ((F.size(left) == 0) & (F.size("cited") > 0)).alias("supported"), F.array_join(left, ",").alias("unknown"))


@query("supporting_evidence", CHUNKS + ", h AS (SELECT * FROM chunks WHERE place = 0), a AS (SELECT document_id, chunk_id AS anchor_id, content AS body, place AS rank FROM chunks WHERE place >= 1) SELECT h.document_id, h.chunk_id, arg_min(anchor_id, rank) AS anchor_id FROM h JOIN a ON a.document_id = h.document_id WHERE NOT contains(h.content, body) GROUP BY 1, 2")
def supporting_evidence(spark: SparkSession, sf: str) -> DataFrame:
    rows = chunks(spark, sf).withColumn("version", F.lit(1))
    anchors = rows.where("place >= 1").withColumns({"rank": F.col("place"), "kind": F.lit("paragraph")})
    return E.supporting(rows.where("place = 0"), anchors)


@query("pdf_heading_level", BLOCKS + r"SELECT document_id, place, CASE WHEN regexp_matches(text, '^\d+\.\d+\s') THEN 2 WHEN regexp_matches(text, '^(\d+\.|Chapter)\s') THEN 1 ELSE 0 END AS level FROM blocks")
def pdf_heading_level(spark: SparkSession, sf: str) -> DataFrame:
    from lodestone.operators import chunking

    t = F.col("text")
    return chunking.blocks(documents(spark, sf)).select("document_id", "place", F.when(t.rlike(r"^\d+\.\d+\s"), 2).when(t.rlike(r"^(\d+\.|Chapter)\s"), 1).otherwise(0).alias("level"))


@query("next_unit", "SELECT min(conv_id) AS conv_id, count(*) AS ready FROM (SELECT conv_id FROM conversations GROUP BY 1 HAVING bool_and(role <> 'system') AND count(*) >= 4)")
def next_unit(spark: SparkSession, sf: str) -> DataFrame:
    done = table(spark, sf, "conversations").groupBy("conv_id").agg(F.bool_and(F.col("role") != "system").alias("all"), F.count(F.lit(1)).alias("n")).where("all and n >= 4")
    return done.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("ready"))


@query("tag_merge_undo", "SELECT doc_id, source AS tag FROM documents")
def tag_merge_undo(spark: SparkSession, sf: str) -> DataFrame:
    """The audit rows of a merge say which links were moved, and moving those back restores the links."""
    links = table(spark, sf, "documents").select("doc_id", F.col("source").alias("tag"))
    target = F.broadcast(links.agg(F.min("tag").alias("into")))
    audit = links.join(target, F.col("tag") != F.col("into")).select("doc_id", F.col("tag").alias("was"))
    merged = links.join(target, F.lit(True)).select("doc_id", F.col("into").alias("tag")).distinct()
    return merged.join(audit, "doc_id", "left").select("doc_id", F.coalesce("was", "tag").alias("tag"))


@query("db_taxonomy", "SELECT d.doc_id, coalesce(l.tag, 'default') AS tag FROM documents d LEFT JOIN (SELECT doc_id, 'q' || quality AS tag FROM labels) l USING (doc_id)")
def db_taxonomy(spark: SparkSession, sf: str) -> DataFrame:
    d, labels = tables(spark, sf, "documents", "labels")
    old = labels.select("doc_id", F.concat(F.lit("q"), "quality").alias("tag"))
    none = d.join(old, "doc_id", "left_anti").select("doc_id", F.lit("default").alias("tag"))
    return old.join(d, "doc_id", "left_semi").unionByName(none)


@query("search_filter_catalog", "SELECT 'lang' AS kind, lang AS value, count(DISTINCT doc_id) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'source', source, count(DISTINCT doc_id) FROM documents GROUP BY 2")
def search_filter_catalog(spark: SparkSession, sf: str) -> DataFrame:
    kinds = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("value")) for c in ("lang", "source")])
    return table(spark, sf, "documents").select("doc_id", F.explode(kinds).alias("x")).groupBy("x.kind", "x.value").agg(F.count_distinct("doc_id").alias("n"))


@query("trash_restore", "SELECT doc_id, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND quality = 0) AS deleted FROM documents")
def trash_restore(spark: SparkSession, sf: str) -> DataFrame:
    """Toxic documents are put into the trash, and those of good quality taken out again."""
    d, labels = table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels")
    trashed = d.join(labels.where("toxic = 1").select("doc_id").distinct(), "doc_id", "left_semi")
    restored = trashed.join(labels.where("quality = 1").select("doc_id"), "doc_id", "left_semi")
    gone = trashed.join(restored, "doc_id", "left_anti").withColumn("deleted", F.lit(True))
    return d.join(gone, "doc_id", "left").select("doc_id", F.coalesce("deleted", F.lit(False)).alias("deleted"))


@query("retry_failed", "WITH l AS (SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS v, max(event_id) AS event_id FROM events GROUP BY 1, 2) SELECT user_id, event_type FROM l WHERE v > 60")
def retry_failed(spark: SparkSession, sf: str) -> DataFrame:
    last = R.latest(table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], ["ts", "event_id"])
    return last.where("value > 60").select("user_id", "event_type")


@query("batch_organize", "SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0) THEN 'picked' ELSE lang END AS category FROM documents")
def batch_organize(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("category"))
    return R.set_values(d, table(spark, sf, "labels").where("quality = 1 and toxic = 0"), "doc_id", "category", "picked")


@query("dataset_candidates", "SELECT document_id FROM (SELECT DISTINCT doc_id AS document_id FROM documents WHERE contains(text, ' | ')) ORDER BY document_id DESC LIMIT 12")
def dataset_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where(F.contains("text", F.lit(" | "))).select(F.col("doc_id").alias("document_id")).distinct().orderBy(F.desc("document_id")).limit(12)


@query("progress_ledger", "SELECT user_id, min(event_id) AS event_id, event_type AS news FROM events GROUP BY user_id, event_type")
def progress_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """What each step of a run adds to what the steps before it had found: the events of a user are its steps, their types the findings."""
    found = R.new_information(table(spark, sf, "events"), ["user_id"], ["event_id"], "event_type")
    return found.withColumnRenamed("event_type", "news")


@query("collect_evidence", LEXICAL + f", f AS (SELECT document_id, sum(1.0 / (60 + rank)) AS score FROM u GROUP BY 1), b AS (SELECT document_id, chunk_id, content, row_number() OVER (PARTITION BY document_id ORDER BY {SCORE} DESC, chunk_id) AS n FROM chunks WHERE {SCORE} >= 2) SELECT f.document_id, b.chunk_id, substr(b.content, 1, 600) AS snippet FROM f JOIN b ON b.document_id = f.document_id AND b.n = 1 ORDER BY f.score DESC, f.document_id LIMIT 8")
def collect_evidence(spark: SparkSession, sf: str) -> DataFrame:
    from lodestone.operators import fusion

    fused = F.broadcast(fusion.rrf(rankings(spark, sf)).withColumnRenamed("score", "fused"))  # two pages at most, so the join needs no shuffle of the chunks
    best = search.best_chunk(scored(spark, sf).join(fused.select("document_id"), "document_id", "left_semi"))
    found = best.join(fused, "document_id").orderBy(F.round("fused", 12).desc(), "document_id").limit(8)
    texts = index(spark, sf).chunks.select("chunk_id", F.substring("content", 1, 600).alias("snippet"))
    return texts.join(F.broadcast(found), "chunk_id").select("document_id", "chunk_id", "snippet")


@query("decode_bytes", "SELECT doc_id, text AS plain, text AS marked FROM documents")
def decode_bytes(spark: SparkSession, sf: str) -> DataFrame:
    """Texts from their bytes, without and with a mark of the encoding in front."""
    raw = F.encode("text", "UTF-8")
    rows = table(spark, sf, "documents").select("doc_id", raw.alias("raw"), F.concat(F.unhex(F.lit("EFBBBF")), raw).alias("with_mark"))
    return rows.select("doc_id", E.decoded("raw").alias("plain"), E.decoded("with_mark").alias("marked"))
