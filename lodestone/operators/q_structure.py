"""Queries of sections, children, windows over blocks and candidates. Blocks are the non-blank lines of documents, forty to a page; headings come from pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import store
from lodestone.catalog import table
from lodestone.operators import chunking
from lodestone.operators import structure as S
from lodestone.operators.q_documents import BLOCKS, documents
from lodestone.operators.registry import query
from lodestone.sources import html

#: Lines of a page.
PAGE = 40


def line_blocks(spark: SparkSession, sf: str) -> DataFrame:
    rows = chunking.blocks(documents(spark, sf))
    level = F.when(F.col("kind") == "heading", F.length(F.regexp_extract("text", "^(#+)", 1)))
    return rows.select("document_id", "place", "kind", level.alias("level"), (F.floor(F.col("place") / PAGE) + 1).cast("int").alias("page"), "text")


def page_blocks(spark: SparkSession, sf: str) -> DataFrame:
    rows = html.html_blocks(table(spark, sf, "pages"))
    return rows.select(F.col("page_id").alias("document_id"), "place", "kind", "level", F.lit(None).cast("int").alias("page"), "text")


# the twins: a recursion over the blocks of each document, in order


def units_sql(name: str, rows: str, key: str = "document_id", pack: int = 480) -> str:
    """u{name}: numbered blocks of rows (key, place, kind, page, t) with size and place; d{name}: which keys are one child."""
    return f"""
u{name} AS MATERIALIZED (SELECT {key}, row_number() OVER w AS i, kind, t, page, length(t) AS n, CAST(coalesce(sum(length(t) + 2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos
  FROM {rows} WINDOW w AS (PARTITION BY {key} ORDER BY place)),
d{name} AS MATERIALIZED (SELECT {key}, sum(n + 2) - 2 <= {pack} AND count(DISTINCT page) <= 1 AS single FROM u{name} GROUP BY ALL)"""


def children_sql(name: str, key: str = "document_id", exact: bool = False, pack: int = 480, hard: int = 780) -> str:
    """c{name}: the children of u{name}."""
    new = f"u.n > {hard} OR g.used < 0 OR g.used + u.n > {pack} OR u.page <> g.p"
    same = " AND ".join(f"u.{k.strip()} = g.{k.strip()}" for k in key.split(","))
    called = "CASE count(DISTINCT kind) WHEN 1 THEN CASE min(kind) WHEN 'list_item' THEN 'list' WHEN 'code_block' THEN 'code' WHEN 'blockquote' THEN 'quote' ELSE min(kind) END ELSE 'mixed' END"
    marked = r"regexp_replace(t, '([。！？!?；;]\s*|\.\s+)', '\1' || chr(30), 'g')"
    if exact:
        pieces = rf"""
b{name} AS MATERIALIZED (SELECT {key}, i, n, list_filter(list_transform(range(1, len(p)), lambda k: CAST(list_sum(list_transform(p[1:k], lambda x: length(x))) AS BIGINT)), lambda e: e > 0) AS ends FROM (SELECT {key}, i, n, string_split(CASE WHEN kind IN ('table', 'code_block') THEN t ELSE {marked} END, chr(30)) AS p FROM u{name} WHERE n > {hard})),
e{name} AS (SELECT {key}, i, n, ends, CAST(0 AS BIGINT) AS since, CAST(0 AS BIGINT) AS piece, CAST(0 AS BIGINT) AS upto FROM b{name} UNION ALL
  SELECT {key}, i, n, ends, upto, piece + 1, CASE WHEN upto + {hard} >= n THEN n ELSE coalesce(list_max(list_filter(ends, lambda e: e > upto AND e <= upto + {pack})), list_min(list_filter(ends, lambda e: e > upto + {pack} AND e <= upto + {hard})), upto + {hard}) END FROM e{name} WHERE upto < n),
l{name} AS (SELECT u.*, piece, since, substr(t, CAST(since + 1 AS INT), CAST(upto - since AS INT)) AS text FROM e{name} g JOIN u{name} u ON {same} AND u.i = g.i WHERE piece > 0 AND trim(substr(t, CAST(since + 1 AS INT), CAST(upto - since AS INT))) <> '')"""
    else:
        sentences = f"list_filter(list_transform(string_split({marked}, chr(30)), lambda x: trim(x)), lambda x: x <> '')"
        over = f"m.used + s.n > {pack}"
        same_s = " AND ".join(f"s.{k.strip()} = m.{k.strip()}" for k in key.split(","))
        pieces = rf"""
q{name} AS MATERIALIZED (SELECT {key}, i, t, CASE WHEN kind = 'table' OR len({sentences}) <= 1 THEN list_transform(range(0, CAST(ceil(n / {hard}) AS BIGINT)), lambda k: substr(t, CAST(k * {hard} + 1 AS INT), {hard})) ELSE {sentences} END AS s, kind = 'table' OR len({sentences}) <= 1 AS hard FROM u{name} WHERE n > {hard}),
s{name} AS MATERIALIZED (SELECT {key}, i, hard, unnest(s) AS text, generate_subscripts(s, 1) AS j, length(unnest(s)) AS n FROM q{name}),
m{name} AS (SELECT {key}, i, j, hard, text, n, 0 AS piece, n + 1 AS used FROM s{name} WHERE j = 1 UNION ALL
  SELECT {key.replace('document_id', 's.document_id').replace('grp', 's.grp')}, s.i, s.j, s.hard, s.text, s.n, CASE WHEN s.hard OR {over} THEN m.piece + 1 ELSE m.piece END, CASE WHEN s.hard OR {over} THEN s.n + 1 ELSE m.used + s.n + 1 END FROM m{name} m JOIN s{name} s ON {same_s} AND s.i = m.i AND s.j = m.j + 1),
z{name} AS (SELECT {key}, i, piece, max(piece) OVER (PARTITION BY {key}, i) AS last, sum(n + 1) - 1 AS size, bool_or(hard) AS hard FROM m{name} GROUP BY {key}, i, piece),
y{name} AS (SELECT {key}, i, piece, CASE WHEN NOT hard AND piece = last AND last > 0 AND size < 80 THEN piece - 1 ELSE piece END AS into_ FROM z{name}),
r{name} AS (SELECT {key}, i, into_ AS piece, string_agg(text, ' ' ORDER BY j) AS text FROM m{name} JOIN y{name} USING ({key}, i, piece) GROUP BY {key}, i, into_),
l{name} AS (SELECT u.*, piece, CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY {', '.join('u.' + k.strip() for k in key.split(','))}, u.i ORDER BY piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS since, text FROM r{name} g JOIN u{name} u ON {same} AND u.i = g.i)"""
    keys = ", ".join("u." + k.strip() for k in key.split(","))
    return f"""
g{name} AS (SELECT {key}, i, 0 AS grp_, CASE WHEN n > {hard} THEN -1 ELSE n + 2 END AS used, page AS p FROM u{name} WHERE i = 1 UNION ALL
  SELECT {keys}, u.i, CASE WHEN {new} THEN g.grp_ + 1 ELSE g.grp_ END, CASE WHEN u.n > {hard} THEN -1 WHEN {new} THEN u.n + 2 ELSE g.used + u.n + 2 END, CASE WHEN {new} THEN u.page ELSE g.p END FROM g{name} g JOIN u{name} u ON {same} AND u.i = g.i + 1),{pieces},
k{name} AS (SELECT {key}, 0 AS grp_, 0 AS piece, {called} AS kind, min(page) AS page, min(pos) AS "begin", max(pos + n) + 2 AS "end", string_agg(t, chr(10) || chr(10) ORDER BY i) AS content FROM u{name} JOIN d{name} USING ({key}) WHERE single GROUP BY {key}
  UNION ALL SELECT {key}, grp_, 0, {called}, min(page), min(pos), max(pos + n), string_agg(t, chr(10) || chr(10) ORDER BY i) FROM u{name} JOIN g{name} USING ({key}, i) JOIN d{name} USING ({key}) WHERE NOT single AND n <= {hard} GROUP BY {key}, grp_
  UNION ALL SELECT {key}, grp_, l.piece, l.kind, l.page, pos + since, pos + since + length(text), text FROM l{name} l JOIN g{name} USING ({key}, i) JOIN d{name} USING ({key}) WHERE NOT single),
c{name} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY grp_, piece) - 1 AS child FROM k{name})"""


def overlap_sql(name: str, key: str = "document_id", most: int = 900) -> str:
    """v{name}: c{name} with the last sentences of the child before in front."""
    return rf"""
o{name} AS (SELECT *, lag(content) OVER w AS before, lag("begin") OVER w AS b0, lag("end") OVER w AS e0, least(120, greatest(0, {most} - 2 - length(content))) AS room FROM c{name} WINDOW w AS (PARTITION BY {key} ORDER BY child)),
ps{name} AS (SELECT {key}, child, room, list_reverse(list_filter(list_transform(string_split(regexp_replace(before, '([。！？!?；;]\s*|\.\s+)', '\1' || chr(30), 'g'), chr(30)), lambda x: trim(x, chr(32) || chr(10))), lambda x: x <> '')) AS s FROM o{name} WHERE before IS NOT NULL AND room > 0),
pl{name} AS (SELECT {key}, child, room, unnest(s) AS x, generate_subscripts(s, 1) AS j FROM ps{name}),
pc{name} AS (SELECT *, sum(length(x) + 1) OVER (PARTITION BY {key}, child ORDER BY j) - 1 AS used FROM pl{name}),
tails{name} AS (SELECT {key}, child, CASE WHEN bool_or(j = 1 AND length(x) > room) THEN trim(right(any_value(x) FILTER (WHERE j = 1), any_value(room)), chr(32) || chr(10)) ELSE string_agg(x, ' ' ORDER BY j DESC) FILTER (WHERE used <= room) END AS tail FROM pc{name} GROUP BY {key}, child),
v{name} AS MATERIALIZED (SELECT {key}, child, CASE WHEN coalesce(tail, '') = '' THEN "begin" ELSE greatest(b0, e0 - length(tail)) END AS "begin", "end", "begin" AS core_begin, "end" AS core_end, CAST(coalesce(length(tail), 0) AS INT) AS overlap,
  CASE WHEN coalesce(tail, '') = '' THEN content ELSE tail || chr(10) || chr(10) || content END AS content FROM o{name} LEFT JOIN tails{name} USING ({key}, child))"""


ROWS = BLOCKS.replace("WITH lines", "WITH RECURSIVE lines") + f""", rows AS MATERIALIZED (SELECT document_id, place, kind, trim(text) AS t, CAST(place // {PAGE} + 1 AS INT) AS page FROM blocks)"""
CHILDREN = ROWS + "," + units_sql("", "rows") + "," + children_sql("")


@query("build_chunks", CHILDREN + """
SELECT 'child' AS role, document_id || ':p:0:c:' || child AS id, kind, page, "begin", "end", content FROM c
UNION ALL SELECT 'parent', document_id || ':p:0', 'section', arg_min(page, i), min(pos), max(pos + n) + 2, CASE WHEN sum(n + 2) - 2 > 80000 THEN substr(string_agg(t, chr(10) || chr(10) ORDER BY i), 1, 39997) || chr(10) || chr(10) || '…' || chr(10) || chr(10) || right(string_agg(t, chr(10) || chr(10) ORDER BY i), 39998) ELSE string_agg(t, chr(10) || chr(10) ORDER BY i) END FROM u GROUP BY document_id""")
def build_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Parents and children of all documents."""
    blocks = line_blocks(spark, sf)
    columns = ["role", "id", "kind", "page", "begin", "end", "content"]
    own = S.children(blocks).withColumns({"role": F.lit("child"), "id": F.col("child_id")}).select(*columns)
    return own.unionByName(S.parents(blocks).withColumns({"role": F.lit("parent"), "id": F.col("parent_id"), "kind": F.lit("section")}).select(*columns))


@query("split_children", CHILDREN + """ SELECT document_id, child, kind, page, "begin", "end", sha256(content) AS content_hash FROM c""")
def split_children(spark: SparkSession, sf: str) -> DataFrame:
    return S.children(line_blocks(spark, sf)).select("document_id", "child", "kind", "page", "begin", "end", F.sha2(F.col("content").cast("binary"), 256).alias("content_hash"))


@query("split_long_text", CHILDREN + " SELECT document_id, i, piece, text FROM r JOIN u USING (document_id, i) WHERE kind <> 'table'")
def split_long_text(spark: SparkSession, sf: str) -> DataFrame:
    """The pieces of every line beyond the hard limit."""
    rows = S.outlined(line_blocks(spark, sf)).withColumn("i", F.expr("row_number() over (partition by document_id order by place)"))
    long = rows.where((F.length("text") > S.Sizes().hard) & (F.col("kind") != "table"))
    return S.split_long(long.select("document_id", "i", "text"), S.Sizes()).select("document_id", "i", F.posexplode("pieces").alias("piece", "text"))


@query("page_children", None)
def page_children(spark: SparkSession, sf: str) -> DataFrame:
    """Children of web pages, whose headings make sections; tests have a second implementation."""
    rows = S.with_overlap(S.children(page_blocks(spark, sf)))
    return rows.withColumn("path", F.array_join("path", " > "))


@query("child_overlap", CHILDREN + "," + overlap_sql("") + """
SELECT document_id, child, "begin", "end", core_begin, core_end, overlap, content FROM v""")
def child_overlap(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.with_overlap(S.children(line_blocks(spark, sf)))
    return rows.select("document_id", "child", "begin", "end", "core_begin", "core_end", "overlap", "content")


@query("chunk_coverage", ROWS + " SELECT document_id, CAST(sum(length(regexp_replace(t, '\\s', '', 'g'))) AS BIGINT) AS chars, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS twice FROM rows GROUP BY 1")
def chunk_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """That exact children hold every character of a document that is not white space once: the characters that they hold by their own places, those that no child holds, and those that two do."""
    blocks = line_blocks(spark, sf)
    return S.coverage(S.children(blocks, exact=True), S.source_texts(blocks)).select("document_id", "chars", "missing", "twice")


# windows

WINDOWS = ROWS + """, b AS MATERIALIZED (SELECT *, length(text) AS n, CAST(place // 40 + 1 AS INT) AS page, row_number() OVER (PARTITION BY document_id ORDER BY place) AS k FROM blocks),
w AS (SELECT document_id, k, 0 AS win, n + 2 AS used, 1 AS many, page AS p, kind = 'table' AS tab FROM b WHERE k = 1 UNION ALL
  SELECT b.document_id, b.k, CASE WHEN {new} THEN w.win + 1 ELSE w.win END, CASE WHEN {new} THEN b.n + 2 ELSE w.used + b.n + 2 END, CASE WHEN {new} THEN 1 ELSE w.many + 1 END, CASE WHEN {new} THEN b.page ELSE w.p END, b.kind = 'table'
  FROM w JOIN b ON b.document_id = w.document_id AND b.k = w.k + 1),
win AS MATERIALIZED (SELECT b.*, w.win AS "window" FROM b JOIN w USING (document_id, k))""".replace("{new}", "(b.page <> w.p OR NOT (w.tab OR b.kind = 'table') AND (w.used + b.n > 6000 OR w.many >= 32))")


@query("candidate_windows", WINDOWS + ' SELECT document_id, "window", count(*) AS n, CAST(sum(n + 2) AS BIGINT) AS size, min(place) AS first, max(place) AS last FROM win GROUP BY ALL')
def candidate_windows(spark: SparkSession, sf: str) -> DataFrame:
    w = S.window_numbers(line_blocks(spark, sf))
    return w.groupBy("document_id", "window").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text") + 2).alias("size"), F.min("place").alias("first"), F.max("place").alias("last"))


@query("source_windows", ROWS + """, b AS MATERIALIZED (SELECT *, length(text) AS n, row_number() OVER (PARTITION BY document_id ORDER BY place) AS k FROM blocks),
s AS (SELECT document_id, k, place, n, CAST(0 AS BIGINT) AS start, least(n, 6000) AS stop, 0 AS "window", 0 AS segment, least(n, 6000) AS used FROM b WHERE k = 1 UNION ALL
  SELECT document_id, k, place, n, start, least(n, start + 6000 - u0), CASE WHEN fresh THEN "window" + 1 ELSE "window" END, CASE WHEN fresh THEN 0 ELSE segment + 1 END, u0 + least(n, start + 6000 - u0) - start
  FROM (SELECT b.document_id, b.k, b.place, b.n, CASE WHEN s.stop < s.n THEN s.stop ELSE 0 END AS start, s."window", s.segment, (s.stop >= s.n AND b.kind = 'heading') OR s.used = 6000 OR s.segment = 31 AS fresh, CASE WHEN (s.stop >= s.n AND b.kind = 'heading') OR s.used = 6000 OR s.segment = 31 THEN 0 ELSE s.used END AS u0
    FROM s JOIN b ON b.document_id = s.document_id AND b.k = CASE WHEN s.stop < s.n THEN s.k ELSE s.k + 1 END))
SELECT document_id, "window", segment, place, CAST(start AS INT) AS start, CAST(stop AS INT) AS stop, start > 0 OR stop < n AS partial FROM s""")
def source_windows(spark: SparkSession, sf: str) -> DataFrame:
    return S.source_segments(line_blocks(spark, sf))


#: Proposals of each window's ends, of every kind that a model gives: all in one, fours, all but the last, the same twice, each alone, halves.
PROPOSALS_SQL = """list_transform(CASE (document_id + "window") % 6 WHEN 0 THEN [m - 1] WHEN 1 THEN list_distinct(list_transform(range(3, m + 3, 4), lambda x: least(x, m - 1))) WHEN 2 THEN [greatest(m - 2, 0)] WHEN 3 THEN [0, 0] WHEN 4 THEN range(0, m) ELSE list_distinct([m // 2, m - 1]) END, lambda x: CAST(x AS BIGINT))"""


def proposals(windows: DataFrame) -> DataFrame:
    m = F.col("m")
    w = windows.groupBy("document_id", "window").agg(F.count(F.lit(1)).cast("int").alias("m"))
    fours = F.array_distinct(F.transform(F.sequence(F.lit(3), m + 2, F.lit(4)), lambda x: F.least(x, m - 1)))
    kind = (F.col("document_id") + F.col("window")) % 6
    ends = (
        F.when(kind == 0, F.array(m - 1)).when(kind == 1, fours).when(kind == 2, F.array(F.greatest(m - 2, F.lit(0)))).when(kind == 3, F.array(F.lit(0), F.lit(0)))
        .when(kind == 4, F.sequence(F.lit(0), m - 1)).otherwise(F.array_distinct(F.array((m / 2).cast("int"), m - 1)))
    )
    return w.select("document_id", "window", ends.alias("ends"))


JUDGED = WINDOWS + f""", x AS MATERIALIZED (SELECT document_id, "window", list(kind ORDER BY place) AS kinds, list(length(text) + 2 ORDER BY place) AS sizes, count(*) AS m FROM win GROUP BY ALL),
p AS MATERIALIZED (SELECT *, list_sort({PROPOSALS_SQL}) AS ends FROM x),
je AS (SELECT document_id, "window", kinds, sizes, m, unnest(ends) AS e, generate_subscripts(ends, 1) AS j, len(ends) AS many, ends FROM p),
jf AS (SELECT *, coalesce(ends[j - 1], -1) AS before FROM je),
jt AS (SELECT document_id, "window", m, many, ends, j, CASE WHEN NOT (before < e AND e < m) THEN 'invalid_boundary' WHEN list_sum(sizes[before + 2:e + 1]) > 6000 THEN 'oversize_group'
  WHEN e < m - 1 AND (kinds[e + 1] = 'table' OR kinds[e + 2] = 'table') THEN 'table_context_split' WHEN e < m - 1 AND kinds[e + 1] = 'heading' THEN 'heading_context_split' END AS bad FROM jf),
judged AS MATERIALIZED (SELECT document_id, "window", any_value(m) AS n, any_value(ends) AS ends, CASE WHEN any_value(many) > any_value(m) THEN 'invalid_count' ELSE coalesce(arg_min(bad, j), CASE WHEN any_value(ends)[-1] <> any_value(m) - 1 THEN 'incomplete_coverage' ELSE 'valid' END) END AS verdict FROM jt GROUP BY ALL)"""
JUDGED = JUDGED.replace('FROM jt GROUP BY ALL', 'FROM jt GROUP BY document_id, "window"')


@query("boundary_validate", JUDGED + ' SELECT document_id, "window", CAST(n AS INT) AS n, verdict FROM judged')
def boundary_validate(spark: SparkSession, sf: str) -> DataFrame:
    w = S.window_numbers(line_blocks(spark, sf))
    return S.judged_groups(w, proposals(w))


RISKS = """risks AS MATERIALIZED (SELECT *, score > 0 AND NOT excluded AS eligible FROM (SELECT document_id, "window", min(place) AS first, max(place) AS last, count(*) AS n,
  (CASE WHEN count(*) FILTER (WHERE kind = 'paragraph') >= 4 AND 10 * count(*) FILTER (WHERE kind = 'paragraph' AND length(trim(text)) < 100) >= 6 * count(*) FILTER (WHERE kind = 'paragraph') THEN 3 ELSE 0 END)
  + (CASE WHEN bool_or(kind = 'paragraph') AND bool_or(kind = 'table') THEN 4 ELSE 0 END) + (CASE WHEN count(*) FILTER (WHERE kind = 'paragraph') >= 2 AND NOT bool_or(kind = 'heading') AND bool_or(kind = 'paragraph' AND length(text) > 900) THEN 2 ELSE 0 END) AS score,
  count(*) < 2 OR bool_or(kind = 'code_block') OR count(*) > 32 OR sum(length(text) + 2) > 6000 OR max(length(text)) > 6000 AS excluded FROM win GROUP BY document_id, "window"))"""


@query("window_risk_score", WINDOWS + ", " + RISKS + ' SELECT document_id, "window", first, last, n, score, excluded, eligible FROM risks')
def window_risk_score(spark: SparkSession, sf: str) -> DataFrame:
    return S.window_risks(S.window_numbers(line_blocks(spark, sf)))


# candidates


@query("candidate_build", JUDGED + ", " + RISKS + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, "window") AS r FROM risks WHERE eligible),
chosen AS MATERIALIZED (SELECT document_id, "window", ends, verdict FROM ranked JOIN judged USING (document_id, "window") WHERE r <= 2),
ok AS MATERIALIZED (SELECT * FROM chosen WHERE verdict = 'valid'),
cutrows AS (SELECT b.*, o.ends, row_number() OVER (PARTITION BY b.document_id, b."window" ORDER BY b.place) - 1 AS q FROM win b LEFT JOIN ok o ON o.document_id = b.document_id AND o."window" = b."window" WHERE b.document_id IN (SELECT document_id FROM ok)),
begun AS (SELECT *, CASE WHEN ends IS NOT NULL THEN q = 0 OR list_contains(ends, q - 1) ELSE coalesce(lag(ends IS NOT NULL) OVER (PARTITION BY document_id ORDER BY place), true) END AS starts FROM cutrows),
grouped AS MATERIALIZED (SELECT document_id, place, kind, trim(text) AS t, page, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY place) AS grp FROM begun),""" + units_sql("", "rows") + "," + children_sql("") + "," + overlap_sql("") + "," + units_sql("x", "grouped", "document_id, grp") + "," + children_sql("x", "document_id, grp") + "," + overlap_sql("x", "document_id, grp") + """,
old AS (SELECT document_id, count(*) AS base, count(*) FILTER (WHERE length(content) < 100) AS base_short FROM v GROUP BY 1), new AS (SELECT document_id, count(*) AS made, count(*) FILTER (WHERE length(content) < 100) AS made_short FROM vx GROUP BY 1),
tried AS (SELECT document_id, count(*) AS windows, count(*) FILTER (WHERE verdict = 'valid') AS accepted FROM chosen GROUP BY 1), seen AS (SELECT document_id, bool_or(excluded) AS limited FROM risks GROUP BY 1)
SELECT document_id, coalesce(windows, 0) AS windows, coalesce(accepted, 0) AS accepted, base, base_short, made, made_short,
  CASE WHEN windows IS NULL THEN CASE WHEN limited THEN 'rules_limited' ELSE 'no_risk' END WHEN accepted = 0 THEN 'model_fallback' WHEN made > base AND made_short >= base_short + 2 THEN 'quality_fallback' ELSE 'applied' END AS decision
FROM old JOIN seen USING (document_id) LEFT JOIN tried USING (document_id) LEFT JOIN new USING (document_id)""")
def candidate_build(spark: SparkSession, sf: str) -> DataFrame:
    """Of each document, the two windows of the highest risk are cut as proposed, where the proposal is valid; the candidate is refused where it has more children and two short ones more than before."""
    windows = store.written(S.window_numbers(line_blocks(spark, sf)), "windows")  # all non-blank blocks are in them
    return S.adaptive_candidate(windows, windows, proposals(windows))


OLDER = S.Sizes(target=1200, most=1800)


@query("structural_candidate", ROWS + "," + units_sql("", "rows", pack=1080) + "," + children_sql("", pack=1080, hard=1680) + "," + overlap_sql("", most=1800) + "," + units_sql("x", "rows") + "," + children_sql("x", exact=True) + "," + overlap_sql("x") + """,
old AS (SELECT document_id, count(*) AS children, count(*) FILTER (WHERE length(content) < 100) AS short_children FROM v GROUP BY 1), new AS (SELECT document_id, count(*) AS made, count(*) FILTER (WHERE length(content) < 100) AS made_short FROM vx GROUP BY 1)
SELECT document_id, children, short_children, made, made_short, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS unverified, made > children AND made_short > short_children AND made_short * children > short_children * made AS regressed FROM old JOIN new USING (document_id)""")
def structural_candidate(spark: SparkSession, sf: str) -> DataFrame:
    """Every document built anew from exact spans, with the proof that it holds all of the source, judged against children that serve now, made with larger sizes."""
    blocks = line_blocks(spark, sf)
    return S.structural_candidate(blocks, S.with_overlap(S.children(blocks, OLDER), OLDER))


@query("structural_coverage", CHILDREN + r""", src AS MATERIALIZED (SELECT document_id, string_agg(t, chr(10) || chr(10) ORDER BY i) AS text FROM u GROUP BY 1),
sp AS (SELECT document_id, "begin" AS b, "begin" + length(content) AS e, content, text, substr(text, CAST("begin" + 1 AS INT), length(content)) = content AS ok FROM c JOIN src USING (document_id)),
rc AS (SELECT *, coalesce(max(e) OVER (PARTITION BY document_id ORDER BY b, content ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reached FROM sp WHERE ok),
gaps AS (SELECT document_id, sum(CASE WHEN b > reached THEN length(regexp_replace(substr(text, CAST(reached + 1 AS INT), CAST(b - reached AS INT)), '\s', '', 'g')) ELSE 0 END) AS missing, sum(CASE WHEN b < reached THEN length(regexp_replace(substr(text, CAST(b + 1 AS INT), CAST(least(e, reached) - b AS INT)), '\s', '', 'g')) ELSE 0 END) AS twice, max(e) AS upto FROM rc GROUP BY 1),
bad AS (SELECT document_id, count(*) FILTER (WHERE NOT ok) AS unverified FROM sp GROUP BY 1)
SELECT document_id, length(regexp_replace(text, '\s', '', 'g')) AS chars, CAST(coalesce(missing, 0) + length(regexp_replace(substr(text, CAST(coalesce(upto, 0) + 1 AS INT)), '\s', '', 'g')) AS BIGINT) AS missing, CAST(coalesce(twice, 0) AS BIGINT) AS twice, coalesce(unverified, 0) AS unverified
FROM src LEFT JOIN gaps USING (document_id) LEFT JOIN bad USING (document_id)""")
def structural_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """What children that are joined anew prove of their source: those of long lines say something else than their places do."""
    blocks = line_blocks(spark, sf)
    return S.coverage(S.children(blocks), S.source_texts(blocks))


#: Words that stand for kinds in the tables' invented languages.
WORDS = {"legal": ["the ", "tion", "which", "with", "ing"], "contract": ["ung", "keit", "lich", "nicht", "und"], "paper": ["ción", "mente", "que", "los", "ado"], "meeting": ["src1", "eaux", "ouque", "dans", "elle"]}


def _signals_sql(kind: str) -> str:
    n = " + ".join(f"CAST(contains(said, '{w}') AS INT)" for w in WORDS[kind])
    return f"CASE WHEN {n} >= 4 THEN 0.9 WHEN {n} = 3 THEN 0.75 WHEN {n} = 2 THEN 0.6 ELSE 0 END"


@query("doc_type_detect", BLOCKS + """, e AS (SELECT *, row_number() OVER (PARTITION BY document_id, kind ORDER BY place) AS r FROM blocks WHERE trim(text) <> ''),
d AS (SELECT document_id, count(*) AS n, count(*) FILTER (WHERE kind = 'code_block') AS code, count(*) FILTER (WHERE kind = 'table') AS tab, string_agg(lower(CASE WHEN kind = 'paragraph' THEN substr(text, 1, 800) ELSE text END), chr(10)) FILTER (WHERE kind = 'paragraph' AND r <= 8 OR kind = 'heading' AND r <= 20) AS said FROM e GROUP BY 1),
t AS (SELECT d.document_id, n, code, tab, lower(coalesce(source, '')) || chr(10) || coalesce(said, '') AS said FROM d JOIN documents ON doc_id = d.document_id),
s AS (SELECT document_id, unnest(['general', 'legal', 'contract', 'paper', 'meeting', 'code', 'table']) AS name, unnest([0, 1, 2, 3, 4, 5, 6]) AS k, CAST(unnest([0, """ + ", ".join(map(_signals_sql, S.WORDED)) + """, CASE WHEN code >= 1 AND code * 2 >= n THEN 0.9 WHEN code >= 2 AND code * 4 >= n THEN 0.7 ELSE 0 END, CASE WHEN tab >= 1 AND tab * 2 >= n THEN 0.9 WHEN tab >= 2 AND tab * 4 >= n THEN 0.7 ELSE 0 END]) AS DOUBLE) AS score FROM t),
r AS (SELECT document_id, name, score, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, k) AS p FROM s),
b AS (SELECT a.document_id, a.name, a.score, round(a.score - c.score, 6) AS margin FROM r a JOIN r c ON c.document_id = a.document_id AND a.p = 1 AND c.p = 2)
SELECT document_id, CASE WHEN score >= 0.6 AND margin >= 0.1 THEN name ELSE 'general' END AS profile, score, margin, round(CASE WHEN score >= 0.6 AND margin >= 0.1 THEN least(score, 1.0) ELSE greatest(0.5, 1 - score) END, 3) AS confidence FROM b""")
def doc_type_detect(spark: SparkSession, sf: str) -> DataFrame:
    titles = documents(spark, sf).select("document_id", F.col("source").alias("title"))
    return S.document_profiles(chunking.blocks(documents(spark, sf)), titles, WORDS)
