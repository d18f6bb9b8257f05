"""Queries of lexical and vector search, fusion and evidence. A chunk is a non-blank line of a document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.catalog import table
from lodestone.functions import text as T
from lodestone.functions import vector as V
from lodestone.operators import fusion, search, term_index
from lodestone.operators.registry import query

CHUNKS = """WITH lines AS (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS place FROM documents),
chunks AS (SELECT doc_id AS document_id, source, lang, doc_id * 4294967296 + place AS chunk_id, place, content FROM lines WHERE trim(content) <> '')
"""


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """document_id, source, lang, chunk_id (unique below 2**31 documents), place and content of each non-blank line."""
    lines = table(spark, sf, "documents").select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("place", "content"))
    return lines.where(F.trim("content") != "").select(F.col("doc_id").alias("document_id"), "source", "lang", (F.col("doc_id") * (1 << 32) + F.col("place")).alias("chunk_id"), F.col("place").cast("long").alias("place"), "content")


def index(spark: SparkSession, sf: str) -> term_index.TermIndex:
    """The index over the chunks, written when the first query asks for it."""
    return term_index.ensure(spark, f"{sf}/documents.parquet", lambda: chunks(spark, sf))


@query("parse_text", CHUNKS + "SELECT document_id, place, content FROM chunks")
def parse_text(spark: SparkSession, sf: str) -> DataFrame:
    return chunks(spark, sf).select("document_id", "place", "content")


@query("normalize_query", r"""WITH t AS (SELECT conv_id, turn, list_distinct(list_transform(regexp_extract_all(lower(trim(text)), '[\p{L}\p{N}_]+'), lambda w: substr(w, 1, 32))) AS w, lower(trim(text)) AS whole FROM conversations)
SELECT conv_id, turn, CASE WHEN len(w) > 0 THEN array_to_string(list_sort(w), ' ') ELSE whole END AS terms FROM t""")
def normalize_query(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(F.array_sort(T.query_terms(F.col("text"))), " ").alias("terms"))


@query("fts_match", CHUNKS + r"""SELECT chunk_id FROM chunks WHERE list_contains(regexp_split_to_array(lower(content), '[^\p{L}\p{N}]+'), 'the') AND list_contains(regexp_split_to_array(lower(content), '[^\p{L}\p{N}]+'), 'with')""")
def fts_match(spark: SparkSession, sf: str) -> DataFrame:
    return index(spark, sf).with_all(["The", "with"]).select("chunk_id")


@query("fts_websearch", CHUNKS + r""", flat AS (SELECT chunk_id, ' ' || array_to_string(regexp_split_to_array(lower(content), '[^\p{L}\p{N}]+'), ' ') || ' ' AS f FROM chunks)
SELECT chunk_id FROM flat WHERE contains(f, ' of the ') AND (contains(f, ' with ') OR contains(f, ' from ')) AND NOT contains(f, ' was ')""")
def fts_websearch(spark: SparkSession, sf: str) -> DataFrame:
    return index(spark, sf).websearch('"of the" with or from -was').select("chunk_id")


#: Minimal covers of two words: behind each entry lies the last entry of either word; a cover begins at the lesser of them where that has moved on.
COVERS = CHUNKS + r""", tok AS (SELECT chunk_id, unnest(regexp_split_to_array(lower(content), '[^\p{L}\p{N}]+')) AS w, generate_subscripts(regexp_split_to_array(lower(content), '[^\p{L}\p{N}]+'), 1) AS pos FROM chunks),
e AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY pos) AS j FROM tok WHERE w IN ('the', 'with')),
l AS (SELECT *, max(CASE WHEN w = 'the' THEN j END) OVER o AS a, max(CASE WHEN w = 'with' THEN j END) OVER o AS b FROM e WINDOW o AS (PARTITION BY chunk_id ORDER BY j)),
s AS (SELECT *, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN least(a, b) END AS first FROM l), c AS (SELECT *, lag(first) OVER (PARTITION BY chunk_id ORDER BY j) AS before FROM s),
ranks AS (SELECT c.chunk_id, round(sum(0.1 / (1 + (c.pos - p.pos) - (c.j - c.first))), 6) AS rank FROM c JOIN e p ON p.chunk_id = c.chunk_id AND p.j = c.first WHERE c.before IS NULL OR c.first > c.before GROUP BY 1)
"""


@query("fts_rank", COVERS + "SELECT chunk_id, rank FROM ranks")
def fts_rank(spark: SparkSession, sf: str) -> DataFrame:
    return index(spark, sf).cover_ranked(["the", "with"]).select("chunk_id", F.round("rank", 6).alias("rank"))


@query("like_match", CHUNKS + "SELECT chunk_id, length(content) AS score FROM chunks WHERE contains(lower(content), 'that%') OR contains(lower(content), 'tion.')")
def like_match(spark: SparkSession, sf: str) -> DataFrame:
    return index(spark, sf).containing_any(["THAT%", "tion."]).select("chunk_id", F.col("length").cast("long").alias("score"))


PATTERNS = [("which", 5), ("tion", 2), ("th", 1), ("ble", 1)]
SCORE = "(CASE WHEN contains(lower(content), 'which') THEN 5 ELSE 0 END + CASE WHEN contains(lower(content), 'tion') THEN 2 ELSE 0 END + CASE WHEN contains(lower(content), 'th') THEN 1 ELSE 0 END + CASE WHEN contains(lower(content), 'ble') THEN 1 ELSE 0 END)"


def scored(spark: SparkSession, sf: str, top: int | None = None, of: str = "chunk_id") -> DataFrame:
    """chunk_id, document_id, length and score; with top, of what may be among the best so many."""
    return index(spark, sf).weighted(PATTERNS, least=2, top=top, of=of)


@query("cjk_match", CHUNKS + f"SELECT chunk_id, {SCORE} AS score FROM chunks WHERE {SCORE} >= 2")
def cjk_match(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).select("chunk_id", "score")


@query("qa_recall", CHUNKS + f"SELECT chunk_id, {SCORE} AS score FROM chunks WHERE {SCORE} >= 2 ORDER BY score DESC, length(content), chunk_id LIMIT 40")
def qa_recall(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf, top=40).orderBy(F.desc("score"), "length", "chunk_id").select("chunk_id", "score").limit(40)


@query("best_chunk_per_document", CHUNKS + f", r AS (SELECT *, {SCORE} AS score, row_number() OVER (PARTITION BY document_id ORDER BY {SCORE} DESC, chunk_id) AS n FROM chunks WHERE {SCORE} >= 2) SELECT document_id, chunk_id, score FROM r WHERE n = 1 ORDER BY score DESC, chunk_id LIMIT 50 OFFSET 10")
def best_chunk_per_document(spark: SparkSession, sf: str) -> DataFrame:
    return search.page(search.best_chunk(scored(spark, sf, 60, "document_id")), "score", 50, 10).select("document_id", "chunk_id", "score")


@query("retain_candidates", CHUNKS + f", r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY {SCORE} DESC, chunk_id) AS n FROM chunks WHERE {SCORE} >= 2) SELECT document_id, chunk_id, n AS place FROM r WHERE n <= 8")
def retain_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return search.best_chunks(scored(spark, sf), per_document=8).select("document_id", "chunk_id", "place")


@query("count_matches", CHUNKS + f"SELECT count(DISTINCT document_id) AS total FROM chunks WHERE {SCORE} >= 2")
def count_matches(spark: SparkSession, sf: str) -> DataFrame:
    return search.count_documents(scored(spark, sf))


@query("browse_filtered", CHUNKS + ", f AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY place) AS n FROM chunks WHERE lang = 'fr') SELECT document_id, chunk_id, content FROM f WHERE n = 1 ORDER BY document_id DESC LIMIT 20")
def browse_filtered(spark: SparkSession, sf: str) -> DataFrame:
    first = chunks(spark, sf).where("lang = 'fr'").groupBy("document_id").agg(F.min_by(F.struct("chunk_id", "content"), "place").alias("c"))
    return first.orderBy(F.desc("document_id")).limit(20).select("document_id", "c.chunk_id", "c.content")


@query("metadata_filters", CHUNKS + "SELECT chunk_id FROM chunks WHERE source IN ('src1', 'src2') AND document_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND contains(lower(content), 'th')")
def metadata_filters(spark: SparkSession, sf: str) -> DataFrame:
    good = table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("document_id"))
    found = chunks(spark, sf).where(F.col("source").isin("src1", "src2") & search.matches_any(F.col("content"), ["th"]))
    return found.join(good, "document_id", "left_semi").select("chunk_id")


@query("snippet_highlight", CHUNKS + """, h AS (SELECT chunk_id, content, CAST(instr(lower(content), 'tion') AS BIGINT) AS at, greatest(1, instr(lower(content), 'tion') - 80) AS b FROM chunks WHERE contains(lower(content), 'tion'))
SELECT chunk_id, CASE WHEN b > 1 THEN '…' ELSE '' END || substr(content, b, 280) || CASE WHEN b + 280 <= length(content) THEN '…' ELSE '' END AS snippet FROM h""")
def snippet_highlight(spark: SparkSession, sf: str) -> DataFrame:
    return search.with_snippets(chunks(spark, sf).where(search.matches_any(F.col("content"), ["tion"])), "tion").select("chunk_id", "snippet")


@query("search_text", CHUNKS + "SELECT chunk_id, source || chr(10) || lang || ' > ' || document_id || chr(10) || content AS search_text FROM chunks")
def search_text(spark: SparkSession, sf: str) -> DataFrame:
    heading = F.concat_ws(" > ", "lang", F.col("document_id").cast("string"))
    return chunks(spark, sf).select("chunk_id", F.concat_ws("\n", "source", heading, "content").alias("search_text"))


@query("taxonomy_attach", """WITH l AS (SELECT doc_id, 1 AS k, 'quality' || quality AS label FROM labels UNION ALL SELECT doc_id, 2, 'toxic' || toxic FROM labels)
SELECT d.doc_id AS document_id, coalesce(string_agg(label, ',' ORDER BY k, label), '') AS labels FROM documents d LEFT JOIN l USING (doc_id) GROUP BY 1""")
def taxonomy_attach(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels")
    links = labels.select(F.col("doc_id").alias("document_id"), F.lit(1).alias("link_id"), F.concat(F.lit("quality"), "quality").alias("label")).union(labels.select("doc_id", F.lit(2), F.concat(F.lit("toxic"), "toxic")))
    return search.attach_labels(table(spark, sf, "documents").select(F.col("doc_id").alias("document_id")), links)


@query("neighbor_context", CHUNKS + """, n AS (SELECT chunk_id, lag(content) OVER w AS p, content, lead(content) OVER w AS s FROM chunks WINDOW w AS (PARTITION BY document_id ORDER BY place)),
a AS (SELECT chunk_id, concat_ws(chr(10) || chr(10), p, content, s) AS around, coalesce(length(p) + 2, 0) + CAST(floor(length(content) / 2) AS BIGINT) AS mid FROM n)
SELECT chunk_id, substr(around, greatest(0, least(mid - 900, length(around) - 1800)) + 1, 1800) AS context FROM a""")
def neighbor_context(spark: SparkSession, sf: str) -> DataFrame:
    return search.neighbours(chunks(spark, sf)).select("chunk_id", "context")


VECTORS = "WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id AS chunk_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q.e AS DOUBLE[])) AS similarity, label FROM embeddings, q)\n"


def vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, list[float]]:
    rows = table(spark, sf, "embeddings").withColumnRenamed("vec_id", "chunk_id")
    return rows, rows.where("chunk_id = 0").first()["embedding"]


@query("vector_topk", VECTORS + "SELECT chunk_id, round(similarity, 5) AS similarity FROM s ORDER BY s.similarity DESC, chunk_id LIMIT 80")
def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.vector_topk(*vectors(spark, sf)).select("chunk_id", F.round("similarity", 5).alias("similarity"))


@query("cosine_similarity", VECTORS + "SELECT chunk_id, round(similarity, 5) AS similarity, CAST(-1 AS DOUBLE) AS mismatch, CAST(0 AS DOUBLE) AS zero FROM s")
def cosine_similarity(spark: SparkSession, sf: str) -> DataFrame:
    rows, q = vectors(spark, sf)
    e, target = F.col("embedding"), F.array(*[F.lit(float(x)) for x in q])
    zeros = F.transform(e, lambda x: F.lit(0.0))
    return rows.select("chunk_id", F.round(V.cosine(e, target), 5).alias("similarity"), V.cosine(F.slice(e, 1, 3), target).alias("mismatch"), V.cosine(zeros, target, 0.0).alias("zero"))


@query("validate_vector", "SELECT vec_id, true AS good, false AS short, false AS broken FROM embeddings")
def validate_vector(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("embedding")
    broken = F.transform(e, lambda x, i: F.when(i == 3, F.lit(float("nan"))).otherwise(x))
    return table(spark, sf, "embeddings").select("vec_id", V.is_valid(e, 64).alias("good"), V.is_valid(F.slice(e, 1, 63), 64).alias("short"), V.is_valid(broken, 64).alias("broken"))


@query("vector_only_filter", VECTORS + ", t AS (SELECT * FROM s ORDER BY similarity DESC, chunk_id LIMIT 80) SELECT chunk_id FROM t WHERE similarity >= (SELECT greatest(max(similarity) * 0.80, max(similarity) - 0.12) FROM t)")
def vector_only_filter(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.vector_only(fusion.vector_topk(*vectors(spark, sf)), True).select("chunk_id")


LEXICAL = CHUNKS + f""", lx AS (SELECT document_id, row_number() OVER (ORDER BY {SCORE} DESC, chunk_id) AS rank FROM chunks WHERE {SCORE} >= 2 ORDER BY rank LIMIT 60),
q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0), vs AS (SELECT vec_id AS document_id, row_number() OVER (ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q.e AS DOUBLE[])) DESC, vec_id) AS rank FROM embeddings, q ORDER BY rank LIMIT 80),
u AS (SELECT document_id, min(rank) AS rank, 'lexical' AS channel FROM lx GROUP BY 1 UNION ALL SELECT document_id, min(rank), 'vector' FROM vs GROUP BY 1)
"""


def rankings(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Pages of fixed size, numbered: the only rows that meet in one task are those pages."""
    lexical = scored(spark, sf, 60).orderBy(F.desc("score"), "chunk_id").limit(60)
    lexical = lexical.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id"))).select("document_id", "rank")
    found = fusion.vector_topk(*vectors(spark, sf))
    found = found.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("similarity"), "chunk_id"))).select(F.col("chunk_id").alias("document_id"), "rank")
    return {"lexical": lexical, "vector": found}


@query("rrf", LEXICAL + "SELECT document_id, round(sum(1.0 / (60 + rank)), 8) AS score FROM u GROUP BY 1")
def rrf(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.rrf(rankings(spark, sf)).select("document_id", F.round("score", 8).alias("score"))


@query("hybrid_documents", LEXICAL + "SELECT document_id, round(sum(1.0 / (60 + rank)), 8) AS score, string_agg(channel, '+' ORDER BY channel) AS channels FROM u GROUP BY 1 ORDER BY sum(1.0 / (60 + rank)) DESC, document_id LIMIT 20")
def hybrid_documents(spark: SparkSession, sf: str) -> DataFrame:
    fused = fusion.rrf(rankings(spark, sf))
    return fused.orderBy(F.desc("score"), "document_id").limit(20).select("document_id", F.round("score", 8).alias("score"), "channels")


@query("evidence_dedup", CHUNKS + ", f AS (SELECT document_id, content, min(chunk_id) AS chunk_id FROM chunks GROUP BY 1, 2), b AS (SELECT *, row_number() OVER w AS n, sum(length(content)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM f WINDOW w AS (PARTITION BY document_id ORDER BY chunk_id)) SELECT document_id, chunk_id FROM b WHERE n <= 12 AND used <= 8000")
def evidence_dedup(spark: SparkSession, sf: str) -> DataFrame:
    first = chunks(spark, sf).groupBy("document_id", "content").agg(F.min("chunk_id").alias("chunk_id")).withColumn("size", F.length("content"))
    return fusion.within_budget(first, "document_id", ["chunk_id"], "size", 12, 8000).select("document_id", "chunk_id")


FEATURES = ["the", "tion", "with", "from", "that", "which", "de", "la"]


@query("evidence_select", CHUNKS + r""", c AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY place) AS rank FROM chunks), k AS (SELECT *, place = 0 AS anchor FROM c),
f AS (SELECT document_id, chunk_id, rank, anchor, unnest(['the', 'tion', 'with', 'from', 'that', 'which', 'de', 'la']) AS feature, content FROM k),
h AS (SELECT * FROM f WHERE list_contains(regexp_split_to_array(lower(content), '[^\p{L}\p{N}]+'), feature)),
d AS (SELECT document_id, feature, count(*) AS df FROM h GROUP BY 1, 2), n AS (SELECT document_id, count(*) AS n FROM k GROUP BY 1),
s AS (SELECT k.document_id, k.chunk_id, k.rank, k.anchor, round(coalesce(sum(1 + ln((1 + n.n) / (1 + d.df))), 0), 6) AS score FROM k JOIN n USING (document_id) LEFT JOIN h ON h.chunk_id = k.chunk_id LEFT JOIN d ON d.document_id = h.document_id AND d.feature = h.feature GROUP BY 1, 2, 3, 4),
r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, anchor DESC, rank, chunk_id) AS p FROM s) SELECT document_id, chunk_id, score FROM r WHERE p = 1""")
def evidence_select(spark: SparkSession, sf: str) -> DataFrame:
    c = chunks(spark, sf).withColumn("rank", F.row_number().over(Window.partitionBy("document_id").orderBy("place")))
    return fusion.feature_evidence(c.withColumns({"anchor": F.col("place") == 0, "title": F.lit("")}), FEATURES)
