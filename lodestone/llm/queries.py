"""The queries of the dealt operators: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import (
    chat_format,
    clusters,
    decontaminate,
    exact_dedup,
    filter_audit,
    jaccard_join,
    langid,
    licences,
    online_packing,
    packing,
    substring_dedup,
    token_files,
    url_filter,
)

TOKENIZER = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf: str) -> DataFrame:
    return langid.identify(_table(spark, sf, "documents"))


def op2_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.contained_items(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"), k=5, percent=80)


OP2_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
d AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
t AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM b)),
n AS (SELECT item_id, count(*) AS n_shingles FROM t GROUP BY 1)
SELECT doc_id, item_id, n_shingles, count(*) AS n_found, count(*) / n_shingles AS containment
FROM d JOIN t USING (s) JOIN n USING (item_id) GROUP BY 1, 2, 3 HAVING count(*) * 100 >= n_shingles * 80"""


def op3_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return substring_dedup.remove_repeats(_table(spark, sf, "documents"), width=20)


#: The rules of the URL query.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op4_url_filters(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.url_verdicts(_table(spark, sf, "pages"), rules)


OP4_SQL = r"""
WITH r(host, path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
p AS (SELECT row_number() OVER () AS k, page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
m AS (SELECT k, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY k ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS n
  FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, host, path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM p LEFT JOIN m ON p.k = m.k AND m.n = 1"""


def op5_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf, "documents"))


OP5_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256 FROM d JOIN g USING (text_sha256)"""


CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op6_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    planted = spark.createDataFrame([(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn long, role string, text string")
    rows = _table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").union(planted)
    return chat_format.read_back(chat_format.windows(rows))


def op7_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf, "documents"), public_tokenizers.path(TOKENIZER))


def op8_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_join.jaccard_groups(_table(spark, sf, "documents"), k=4, percent=85)


def op9_token_files(spark: SparkSession, sf: str) -> DataFrame:
    return token_files.token_index_of(_table(spark, sf, "documents"), public_tokenizers.path(TOKENIZER))


def op10_licences(spark: SparkSession, sf: str) -> DataFrame:
    return licences.licences(_table(spark, sf, "documents"))


def op11_centroids(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.cluster(_table(spark, sf, "embeddings"), k=8, rounds=10, size=64, scale=1024, seed=3)


def _op11_round(k: int) -> str:
    """Assignment k and the centroids after it; a division of whole numbers that rounds down."""
    return f"""
a{k} AS MATERIALIZED (SELECT i, k, d FROM (SELECT v.i, c.k, sum((v.x - c.x) * (v.x - c.x)) AS d, row_number() OVER (PARTITION BY v.i ORDER BY sum((v.x - c.x) * (v.x - c.x)), c.k) AS n FROM v JOIN c{k} c USING (dim) GROUP BY 1, 2) WHERE n = 1),
s{k} AS MATERIALIZED (SELECT a.k, dim, sum(x) AS s, count(*) AS n FROM a{k} a JOIN v USING (i) GROUP BY 1, 2),
c{k + 1} AS MATERIALIZED (SELECT c.k, c.dim, CASE WHEN s.n IS NULL THEN c.x ELSE (s.s - ((s.s % s.n) + s.n) % s.n) // s.n END AS x FROM c{k} c LEFT JOIN s{k} s ON s.k = c.k AND s.dim = c.dim),"""


OP11_SQL = (
    """
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id, embedding AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
v AS MATERIALIZED (SELECT i, unnest(range(64)) AS dim, CAST(floor(CAST(unnest(e) AS DOUBLE) * 1024) AS HUGEINT) AS x FROM kept),
f AS MATERIALIZED (SELECT i, row_number() OVER (ORDER BY sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')), e) - 1 AS k FROM kept),
c0 AS MATERIALIZED (SELECT k, dim, x FROM f JOIN v USING (i) WHERE k < 8),"""
    + "".join(map(_op11_round, range(11)))
    + """
h AS (SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY dim)) AS centroid_sha256 FROM c10 GROUP BY 1),
t AS (SELECT k, sum(d) AS s FROM a10 GROUP BY 1)
SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(t.s AS BIGINT) AS cluster_inertia, CAST((SELECT sum(s) FROM t) AS BIGINT) AS inertia, centroid_sha256
FROM a10 JOIN kept USING (i) JOIN h USING (k) JOIN t USING (k)"""
)


def op12_filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


OP12_SQL = r"""
WITH l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS bad FROM labels GROUP BY 1),
w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
m AS (SELECT t, min(doc_id) AS least FROM w GROUP BY 1),
d AS MATERIALIZED (SELECT row_number() OVER () AS i, part, coalesce(good, false) AS good, coalesce(bad, false) AS bad,
  [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(w.doc_id > m.least, false)] AS fails
  FROM w JOIN m USING (t) LEFT JOIN l USING (doc_id)),
f AS (SELECT i, part, good, bad, len(list_filter(fails, lambda x: x)) AS many, unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest(fails) AS fail FROM d),
p AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT p1.x || p2.x || p3.x || p4.x || p5.x AS filter_order FROM p p1, p p2, p p3, p p4, p p5 WHERE len(list_distinct([p1.x, p2.x, p3.x, p4.x, p5.x])) = 5),
r AS (SELECT part, filter_order, x, instr(filter_order, x) AS step, good, bad, many, fail, min(CASE WHEN fail THEN instr(filter_order, x) ELSE 6 END) OVER (PARTITION BY i, filter_order) AS hit FROM f, o),
c AS (SELECT part, filter_order, x, CAST(step AS INTEGER) AS step, count(*) FILTER (WHERE hit > step) AS kept, count(*) FILTER (WHERE hit = step) AS removed, count(*) FILTER (WHERE fail AND hit < step) AS redundant,
  count(*) FILTER (WHERE fail AND many = 1) AS unique_fails, count(*) FILTER (WHERE hit = step AND good) AS good_lost, count(*) FILTER (WHERE hit = step AND bad) AS toxic_lost FROM r GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM c"""


def op13_online_packing(spark: SparkSession, sf: str) -> DataFrame:
    return online_packing.pack_online(_table(spark, sf, "documents"), public_tokenizers.path(TOKENIZER), capacity=2048, end_id=1)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_decontamination, op3_substring_dedup, op4_url_filters, op5_exact_dedup, op6_chat_format, op7_best_fit_packing, op8_jaccard_join, op9_token_files, op10_licences, op11_centroids, op12_filter_audit, op13_online_packing)}


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": OP2_SQL, "op4_url_filters": OP4_SQL, "op5_exact_dedup": OP5_SQL, "op11_centroids": OP11_SQL, "op12_filter_audit": OP12_SQL}
