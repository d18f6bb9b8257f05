"""Queries of sources, parsing, chunking and source navigation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from lodestone.catalog import table
from lodestone.functions import text as T
from lodestone.operators import chunking as C
from lodestone.operators.registry import query
from lodestone.sources import html, tables

LINES = "WITH lines AS (SELECT doc_id AS document_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS place, unnest(string_split(text, chr(10))) AS line FROM documents)"


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").withColumnRenamed("doc_id", "document_id")


BLOCKS = LINES + r""", f AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^\s*```') THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY place) AS fences FROM lines),
blocks AS (SELECT document_id, place, line AS text, CASE WHEN fences % 2 = 1 THEN 'code_block' WHEN regexp_matches(line, '^#{1,6}\s') THEN 'heading' WHEN regexp_matches(line, '^\s*([-*+]|\d+[.)])\s+') THEN 'list_item' WHEN regexp_matches(line, '^\s*>') THEN 'blockquote' WHEN contains(line, ' | ') THEN 'table' ELSE 'paragraph' END AS kind
  FROM f WHERE trim(line) <> '' AND NOT regexp_matches(line, '^\s*```'))
"""


@query("parse_markdown", BLOCKS + "SELECT document_id, place, kind, text FROM blocks")
def parse_markdown(spark: SparkSession, sf: str) -> DataFrame:
    return C.blocks(documents(spark, sf))


@query("parse_note", LINES + r" SELECT document_id, place, CASE WHEN regexp_matches(line, '^#{1,6}\s*\S') THEN 'heading' WHEN regexp_matches(line, '^\s*([-*+]|\d+[.)])\s+') THEN 'list_item' WHEN regexp_matches(line, '^\s*>') THEN 'blockquote' WHEN contains(line, ' | ') THEN 'table' ELSE 'paragraph' END AS kind FROM lines WHERE trim(line) <> ''")
def parse_note(spark: SparkSession, sf: str) -> DataFrame:
    return C.blocks(documents(spark, sf), heading=r"^#{1,6}\s*\S").select("document_id", "place", "kind")


@query("block_type_counts", BLOCKS + "SELECT kind, count(*) AS n FROM blocks GROUP BY 1")
def block_type_counts(spark: SparkSession, sf: str) -> DataFrame:
    return C.blocks(documents(spark, sf)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("chunk_type", BLOCKS + "SELECT document_id, CASE WHEN count(DISTINCT kind) = 1 THEN min(kind) ELSE 'mixed' END AS chunk_type FROM blocks GROUP BY 1")
def chunk_type(spark: SparkSession, sf: str) -> DataFrame:
    return C.blocks(documents(spark, sf)).groupBy("document_id").agg(F.when(F.min("kind") == F.max("kind"), F.min("kind")).otherwise("mixed").alias("chunk_type"))


OPENS = "kind = 'heading'"


@query("sectionize", BLOCKS + f"SELECT document_id, place, CAST(sum(CASE WHEN {OPENS} THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY place) AS BIGINT) AS section FROM blocks")
def sectionize(spark: SparkSession, sf: str) -> DataFrame:
    return C.sections(C.blocks(documents(spark, sf)), F.expr(OPENS)).select("document_id", "place", "section")


@query("cell_normalise", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS t, '[binary ' || strlen(o_orderpriority) || ' bytes sha256:' || sha256(o_orderpriority) || ']' AS b, CASE WHEN o_orderstatus = 'F' THEN '1' ELSE '0' END AS f, substr(o_orderpriority, 1, 4096) AS s FROM orders")
def cell_normalise(spark: SparkSession, sf: str) -> DataFrame:
    cell = tables.cell_text
    return table(spark, sf, "orders").select("o_orderkey", cell(F.col("o_orderdate"), ST.TimestampType()).alias("t"), cell(F.col("o_orderpriority").cast("binary"), ST.BinaryType()).alias("b"), cell(F.col("o_orderstatus") == "F", ST.BooleanType()).alias("f"), cell(F.col("o_orderpriority"), ST.StringType()).alias("s"))


@query("cell_format", "SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS padded, CASE WHEN c_acctbal > 0 THEN 'TRUE' ELSE 'FALSE' END AS flag, CAST(CAST(round(c_acctbal * 100) AS BIGINT) AS VARCHAR) || '%' AS percent, replace(c_name || chr(10) || c_mktsegment, chr(10), '↵') AS lines FROM customer")
def cell_format(spark: SparkSession, sf: str) -> DataFrame:
    percent = F.concat(F.round(F.col("c_acctbal") * 100).cast("long").cast("string"), F.lit("%"))
    return table(spark, sf, "customer").select("c_custkey", F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("padded"), F.when(F.col("c_acctbal") > 0, "TRUE").otherwise("FALSE").alias("flag"), percent.alias("percent"), F.replace(F.concat("c_name", F.lit("\n"), "c_mktsegment"), F.lit("\n"), F.lit("↵")).alias("lines"))


@query("parse_html", None)
def parse_html(spark: SparkSession, sf: str) -> DataFrame:
    return html.html_blocks(table(spark, sf, "pages"))


@query("html_metadata", "SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, regexp_extract(html, '(?is)<html[^>]*\\slang=[\"'']?([A-Za-z-]+)', 1) AS lang FROM pages")
def html_metadata(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", html.title(F.col("html")).alias("title"), html.language(F.col("html")).alias("lang"))


@query("html_strip", r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', '', 'g'), '(?i)<(br|/p|/h[1-6]|/li|/div|/title)[^>]*>', chr(10), 'g') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '(?s)<[^>]*>', '', 'g'), '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g') AS t FROM a) SELECT page_id, trim(regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g')) AS text FROM b""")
def html_strip(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", html.visible_text(F.col("html")).alias("text"))


@query("normalize_url", "SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || lower(regexp_extract(url, '://([^/?#]*)', 1)) || rtrim(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/') AS url FROM pages")
def normalize_url(spark: SparkSession, sf: str) -> DataFrame:
    part = lambda p: F.regexp_extract("url", p, 1)
    return table(spark, sf, "pages").select("page_id", F.concat(F.lower(part("^([A-Za-z]+)://")), F.lit("://"), F.lower(part("://([^/?#]*)")), F.rtrim(part("://[^/?#]*([^?#]*)"), F.lit("/"))).alias("url"))


@query("remote_identity", "SELECT page_id, sha256('webdav:' || regexp_extract(url, '^([a-z]+://[^/?#]*[^?#]*)', 1)) AS identity FROM pages")
def remote_identity(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.sha2(F.concat(F.lit("webdav:"), F.regexp_extract("url", "^([a-z]+://[^/?#]*[^?#]*)", 1)).cast("binary"), 256).alias("identity"))


@query("parser_dispatch", "SELECT page_id, CASE WHEN ends_with(p, '.html') THEN 'html' WHEN ends_with(p, '.md') THEN 'markdown' WHEN ends_with(p, '/') THEN 'folder' ELSE 'text' END AS parser FROM (SELECT page_id, lower(regexp_extract(url, '^[^?#]*')) AS p FROM pages)")
def parser_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    p = F.lower(F.regexp_extract("url", "^[^?#]*", 0))
    return table(spark, sf, "pages").select("page_id", F.when(p.endswith(".html"), "html").when(p.endswith(".md"), "markdown").when(p.endswith("/"), "folder").otherwise("text").alias("parser"))


@query("sanitize_unicode", "SELECT doc_id, length(text) AS n, replace(text, chr(1), '') AS text FROM documents")
def sanitize_unicode(spark: SparkSession, sf: str) -> DataFrame:
    dirty = F.concat(F.lit("\0"), F.col("text"), F.lit("\0"))
    clean = F.make_valid_utf8(F.translate(dirty, "\0", ""))
    return table(spark, sf, "documents").select("doc_id", F.length(clean).alias("n"), clean.alias("text"))


@query("import_batch", "SELECT doc_id FROM documents WHERE doc_id <= (SELECT max(vec_id) FROM embeddings) AND lang <> 'en' AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) ORDER BY doc_id DESC LIMIT 50")
def import_batch(spark: SparkSession, sf: str) -> DataFrame:
    """The last batch up to the id that was the greatest when the import began (the last one with a vector); rows that came later are not part of it, nor are those in a state that is not imported (labelled toxic)."""
    rows, labels, vectors = table(spark, sf, "documents"), table(spark, sf, "labels"), table(spark, sf, "embeddings")
    through = vectors.agg(F.max("vec_id").alias("through_id"))  # one row
    barred = labels.where("toxic = 1").select("doc_id")
    kept = rows.join(F.broadcast(through), F.col("doc_id") <= F.col("through_id")).where("lang <> 'en'").join(barred, "doc_id", "left_anti")
    return kept.orderBy(F.desc("doc_id")).select("doc_id").limit(50)


@query("sink_export", "SELECT '# ' || source || chr(10) || chr(10) || text AS value FROM documents")
def sink_export(spark: SparkSession, sf: str) -> DataFrame:
    return tables.as_markdown(table(spark, sf, "documents").withColumn("title", F.col("source")))


@query("scan_rowstore", "SELECT n_nationkey AS row_number, n_name AS name, CAST(n_regionkey AS VARCHAR) AS region FROM nation")
def scan_rowstore(spark: SparkSession, sf: str) -> DataFrame:
    values = F.create_map(F.lit("name"), F.col("n_name"), F.lit("region"), F.col("n_regionkey").cast("string"))
    rows = tables.bounded(table(spark, sf, "nation").select(F.col("n_nationkey").alias("row_number"), values.alias("values")), 150_000)
    return rows.select("row_number", F.col("values")["name"].alias("name"), F.col("values")["region"].alias("region"))


@query("scan_parquet", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01 00:00:00' AND l_quantity < 5")
def scan_parquet(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").where((F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp")) & (F.col("l_quantity") < 5)).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("source_db_catalog", "SELECT column_name AS name, ordinal_position AS place FROM information_schema.columns WHERE table_name = 'orders'")
def source_db_catalog(spark: SparkSession, sf: str) -> DataFrame:
    fields = table(spark, sf, "orders").schema.fields
    return spark.createDataFrame([(f.name, i + 1) for i, f in enumerate(fields)], "name string, place int")


@query("ocr_line_aggregate", r"""WITH w AS (SELECT doc_id, i, i // 8 AS line, w[i + 1] AS word FROM (SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)))
SELECT doc_id, line, string_agg(word, ' ' ORDER BY i) AS text, min(i % 8 * 10) AS x0, max(i % 8 * 10 + length(word)) AS x1, round(avg(i % 100), 4) AS confidence FROM w GROUP BY 1, 2""")
def ocr_line_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    """Eight words a line. A text gives whole lines, so nothing is shuffled but the ids; where rows share an id (or several have none), lines of one number are merged."""
    docs = table(spark, sf, "documents")
    lines = C.lines_of_words(docs.select("doc_id", "text"), 8)
    if docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        lines = lines.withColumn("texts", F.array("text"))
    else:
        lines = lines.groupBy("doc_id", "line").agg(F.collect_list("text").alias("texts"))
    words = F.flatten(F.transform("texts", lambda t: F.transform(F.split(t, " "), lambda w, k: F.struct(k.alias("k"), w.alias("word")))))
    rows = lines.select("doc_id", "line", F.array_sort(words).alias("w"))
    total = lambda f: F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + f(x))
    place = lambda x: (F.col("line") * 8 + x["k"]) % 100
    end = F.array_max(F.transform("w", lambda x: x["k"] * 10 + F.length(x["word"])))
    text = F.array_join(F.transform("w", lambda x: x["word"]), " ")
    confidence = F.round(total(place) / F.size("w"), 4)
    return rows.select("doc_id", "line", text.alias("text"), F.array_min(F.transform("w", lambda x: x["k"] * 10)).alias("x0"), end.alias("x1"), confidence.alias("confidence"))


@query("ocr_select", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND length(text) > 200 THEN 'external' WHEN length(text) < 40 THEN 'none' ELSE 'local' END AS chosen FROM documents")
def ocr_select(spark: SparkSession, sf: str) -> DataFrame:
    local, outside = F.struct(F.lit("local").alias("name"), (F.col("doc_id") % 3).alias("defects")), F.length("text") > 200
    return table(spark, sf, "documents").select("doc_id", F.when((local["defects"] == 0) & outside, "external").when(F.length("text") < 40, "none").otherwise(local["name"]).alias("chosen"))


@query("chunk_quality", BLOCKS + """, p AS (SELECT document_id, count(*) AS n, count(*) FILTER (WHERE length(text) < 80) AS n_short, count(*) - count(DISTINCT text) AS n_repeated FROM blocks GROUP BY 1),
s AS (SELECT *, 100 - CAST(round_even(45.0 * n_short / n, 0) AS BIGINT) - least(2 * n_repeated, 20) AS score FROM p) SELECT document_id, n, n_short, n_repeated, score, CASE WHEN score >= 80 THEN 'good' WHEN score >= 60 THEN 'review' ELSE 'fallback' END AS verdict FROM s""")
def chunk_quality(spark: SparkSession, sf: str) -> DataFrame:
    return C.chunk_quality(C.blocks(documents(spark, sf)).withColumnRenamed("text", "content"))


@query("split_sentences", r"SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[.!?]\s+')) AS s FROM documents) WHERE trim(regexp_replace(s, '[.!?]', '', 'g')) <> '' GROUP BY 1")
def split_sentences(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", r"(?<=[.!?])\s+")).alias("s"))
    return s.where(F.trim(F.regexp_replace("s", "[.!?]", "")) != "").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("hard_split", "SELECT doc_id, i AS place, substr(text, i * 600 + 1, 600) AS piece FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 600) AS BIGINT))) AS i FROM documents)")
def hard_split(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.posexplode(T.windows(F.col("text"), 600)).alias("place", "piece"))


@query("token_estimate", "SELECT doc_id, greatest(1, length(text) // 4) AS tokens FROM documents")
def token_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query("content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))


@query("bounded_parent", "SELECT doc_id, CASE WHEN length(text) <= 80000 THEN text ELSE substr(text, 1, 39998) || chr(10) || '…' || chr(10) || right(text, 39999) END AS parent FROM documents")
def bounded_parent(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.bounded(F.col("text"), 80_000).alias("parent"))


@query("merge_extras", BLOCKS + "SELECT document_id, min(place) AS row_start, max(place) AS row_end, round(avg(length(text)), 4) AS confidence FROM blocks WHERE kind = 'table' GROUP BY 1")
def merge_extras(spark: SparkSession, sf: str) -> DataFrame:
    rows = C.blocks(documents(spark, sf)).where("kind = 'table'")
    return rows.groupBy("document_id").agg(F.min("place").alias("row_start"), F.max("place").alias("row_end"), F.round(F.avg(F.length("text")), 4).alias("confidence"))


@query("chunk_profile", "SELECT kind, CASE kind WHEN 'table' THEN 1800 WHEN 'code_block' THEN 1200 ELSE 600 END AS target FROM (" + BLOCKS + "SELECT DISTINCT kind FROM blocks)")
def chunk_profile(spark: SparkSession, sf: str) -> DataFrame:
    names = F.when(F.col("kind") == "table", C.PROFILES["table"][0]).when(F.col("kind") == "code_block", C.PROFILES["code"][0]).otherwise(C.PROFILES["general"][0])
    return C.blocks(documents(spark, sf)).select("kind").distinct().select("kind", names.alias("target"))


@query("prepare_structured", BLOCKS + ", h AS (SELECT document_id, text, min(place // 5) <> max(place // 5) AS rep FROM blocks WHERE length(text) < 60 GROUP BY 1, 2) SELECT b.document_id, b.place, CASE WHEN length(b.text) >= 60 THEN b.kind WHEN h.rep THEN 'paragraph' ELSE 'heading' END AS kind FROM blocks b LEFT JOIN h USING (document_id, text)")
def prepare_structured(spark: SparkSession, sf: str) -> DataFrame:
    rows = C.blocks(documents(spark, sf)).withColumn("kind", F.when(F.length("text") < 60, "heading").otherwise(F.col("kind")))
    return C.demote_repeated_headings(rows, F.floor(F.col("place") / 5)).select("document_id", "place", "kind")


@query("replace_chunks", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END AS version FROM documents")
def replace_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The new version's chunks replace those of older versions of the same documents."""
    d = table(spark, sf, "documents").select("doc_id")
    old, new = d.withColumn("version", F.lit(1)), d.where("doc_id % 2 = 0").withColumn("version", F.lit(2))
    return old.join(new.select("doc_id"), "doc_id", "left_anti").union(new)


@query("chunk_inspect", BLOCKS + "SELECT document_id, place, substr(text, 1, 2400) AS text FROM blocks ORDER BY document_id, place LIMIT 40 OFFSET 80")
def chunk_inspect(spark: SparkSession, sf: str) -> DataFrame:
    return C.blocks(documents(spark, sf)).orderBy("document_id", "place").offset(80).limit(40).select("document_id", "place", F.substring("text", 1, 2400).alias("text"))


@query("ai_input_sample", "SELECT doc_id, CASE WHEN length(text) <= 8000 THEN text ELSE substr(text, 1, 3000) || substr(text, length(text) // 2 - 999, 2000) || right(text, 3000) END AS sample FROM documents")
def ai_input_sample(spark: SparkSession, sf: str) -> DataFrame:
    n, t = F.length("text"), F.col("text")
    middle = F.substring(t, F.floor(n / 2).cast("int") - 999, F.lit(2000))
    return table(spark, sf, "documents").select("doc_id", F.when(n <= 8000, t).otherwise(F.concat(F.substring(t, 1, 3000), middle, F.substring(t, -3000, 3000))).alias("sample"))


@query("document_map", BLOCKS + "SELECT document_id, 'v1:' || sha256(text) || ':b' || place AS block_id, kind FROM blocks")
def document_map(spark: SparkSession, sf: str) -> DataFrame:
    return C.blocks(documents(spark, sf)).select("document_id", F.concat(F.lit("v1:"), F.sha2(F.col("text").cast("binary"), 256), F.lit(":b"), F.col("place").cast("string")).alias("block_id"), "kind")


@query("outline", BLOCKS + "SELECT document_id, place, substr(text, 1, 200) AS title FROM blocks WHERE length(text) < 60 ORDER BY document_id, place LIMIT 100")
def outline(spark: SparkSession, sf: str) -> DataFrame:
    return C.blocks(documents(spark, sf)).where(F.length("text") < 60).orderBy("document_id", "place").select("document_id", "place", F.substring("text", 1, 200).alias("title")).limit(100)


@query("read_block", "SELECT doc_id, substr(text, 101, 500) AS part, CASE WHEN length(text) > 600 THEN 600 END AS next_offset, length(text) > 600 AS partial FROM documents")
def read_block(spark: SparkSession, sf: str) -> DataFrame:
    more = F.length("text") > 600
    return table(spark, sf, "documents").select("doc_id", F.substring("text", 101, 500).alias("part"), F.when(more, 600).alias("next_offset"), more.alias("partial"))


@query("parent_child_tree", BLOCKS + "SELECT document_id, count(*) AS children, CAST(sum(length(text)) AS BIGINT) AS chars FROM blocks GROUP BY 1")
def parent_child_tree(spark: SparkSession, sf: str) -> DataFrame:
    children = C.blocks(documents(spark, sf)).withColumn("external_id", F.concat_ws(":c:", F.col("document_id").cast("string"), F.col("place").cast("string")))
    return children.groupBy("document_id").agg(F.count("external_id").alias("children"), F.sum(F.length("text")).alias("chars"))


@query("fragment_recovery", BLOCKS + ", p AS (SELECT document_id, place // 10 AS page, count(*) AS n, count(*) FILTER (WHERE length(text) <= 60) AS small, string_agg(text, chr(10) ORDER BY place) AS page_text FROM blocks GROUP BY 1, 2) SELECT document_id, page, page_text FROM p WHERE n BETWEEN 3 AND 512 AND small >= 0.6 * n AND length(page_text) <= 4000")
def fragment_recovery(spark: SparkSession, sf: str) -> DataFrame:
    rows = C.blocks(documents(spark, sf)).withColumn("page", F.floor(F.col("place") / 10))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "\n")
    p = rows.groupBy("document_id", "page").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.length("text") <= 60).alias("small"), text.alias("page_text"))
    return p.where("n between 3 and 512 and small >= 0.6 * n and length(page_text) <= 4000").select("document_id", "page", "page_text")


@query("sample_chunks", "WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents) SELECT doc_id FROM n WHERE i IN (SELECT CAST(round_even(p * (SELECT max(n) - 1 FROM n) / 15.0, 0) AS BIGINT) FROM range(16) t(p))")
def sample_chunks(spark: SparkSession, sf: str) -> DataFrame:
    from lodestone.operators.ranks import global_rank

    d = table(spark, sf, "documents").select("doc_id")
    n = d.count()
    wanted = sorted({round(p * (n - 1) / 15) for p in range(16)}) if n else []
    return global_rank(d, "doc_id").where(F.col("rank").isin(wanted)).select("doc_id")
