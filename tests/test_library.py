import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone import store
from lodestone.functions import text, typed, vector
from lodestone.operators import chunking, evidence, fusion, profile, relations, search
from lodestone.operators.ranks import global_rank
from lodestone.sources import html, snapshots, tables
from lodestone.streaming import jobs


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize("cell, want", [
    ("1,234", 1234.0), ("12%", 0.12), ("10.0（原始值：10）", 10.0), ("¥5.5元", 5.5), ("abc", None), ("", None), ("  7 ", 7.0), ("12.3%（原始值：0.123）", 0.123), ("1e3", 1000.0), ("inf", float("inf")), ("３", None), (None, None),
])
def test_numbers(spark, cell, want):
    assert one(spark, typed.number(F.lit(cell).cast("string"))) == want


def test_dates(spark):
    get = lambda f, v: str(one(spark, f(F.lit(v).cast("string"))))
    assert get(typed.date, "2024/01/05") == "2024-01-05" and get(typed.date, "2024年1月5日") == "None"
    assert get(typed.calendar_date, "2024年1月5日") == "2024-01-05" and get(typed.calendar_date, "2024-02-30") == "None"


def test_vectors(spark):
    a = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    assert one(spark, vector.cosine(a(1, 0), a(1, 1))) == pytest.approx(0.70710678)
    assert one(spark, vector.cosine(a(1), a(1, 1))) == -1.0 and one(spark, vector.cosine(a(0, 0), a(1, 1), 0.0)) == 0.0
    assert one(spark, vector.is_valid(a(1, float("nan")), 2)) is False and one(spark, vector.is_valid(F.lit(None).cast("array<double>"), 2)) is False


def test_text_expressions(spark):
    assert one(spark, text.token_estimate(F.lit("华东 abcdefgh"))) == 2 + 2
    assert one(spark, text.query_terms(F.lit("Foo 区 foo bar"))) == ["foo", "bar"]
    assert one(spark, text.query_terms(F.lit("区"))) == ["区"]
    assert one(spark, text.sentences(F.lit("你好。Yes! No"))) == ["你好。", "Yes!", "No"]
    assert one(spark, text.windows(F.lit("abcde"), 2)) == ["ab", "cd", "e"]


def test_rrf_counts_the_first_place_only(spark):
    rank = lambda ids: spark.createDataFrame([(d, i + 1) for i, d in enumerate(ids)], "document_id long, rank int")
    got = {r.document_id: r.score for r in fusion.rrf({"a": rank([1, 2, 3]), "b": rank([3, 1, 4, 1])}).collect()}
    assert len(got) == 4 and got[1] > got[2] and got[3] > got[4]
    assert got[1] == pytest.approx(1 / 61 + 1 / 62)


def test_vector_only(spark):
    rows = spark.createDataFrame([(1, 0.31), (2, 0.81), (3, 0.99)], "chunk_id long, similarity double")
    assert [r.chunk_id for r in fusion.vector_only(rows, True).collect()] == [3]
    assert fusion.vector_only(rows, False).count() == 3


def test_websearch(spark):
    rows = spark.createDataFrame([(1, "red apple pie"), (2, "green apple"), (3, "apple red"), (4, "pear 100%")], "id long, t string")
    find = lambda q: [r.id for r in rows.where(search.websearch(F.col("t"), q)).orderBy("id").collect()]
    assert find("apple red") == [1, 3] and find('"red apple"') == [1] and find("green or pear") == [2, 4] and find("apple -red") == [2] and find("!!") == []
    assert [r.id for r in rows.where(search.matches_any(F.col("t"), ["0%"])).collect()] == [4]


def test_code_fences_and_headings(spark):
    docs = spark.createDataFrame([(1, "# T\n```\n# no\n```\n- item\n> q\nplain")], "document_id long, text string")
    assert [r.kind for r in chunking.blocks(docs).orderBy("place").collect()] == ["heading", "code_block", "list_item", "blockquote", "paragraph"]


def test_html(spark):
    page = "<html lang='en-GB'><head><title> A &amp; B</title><style>p{}</style></head><nav><p>no</p></nav><h2>Head</h2><p>One <b>two</b>\n three<p>next</p>stray<ul><li>x</li></ul><script>var a='<p>no</p>'</script>"
    frame = spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")
    assert [(r.kind, r.level, r.text) for r in html.html_blocks(frame).collect()] == [("heading", 2, "Head"), ("paragraph", 0, "One two three"), ("paragraph", 0, "next"), ("list_item", 0, "x")]
    assert frame.select(html.language(F.col("html"))).first()[0] == "en-GB"


def test_snapshots_switch_atomically(spark, tmp_path):
    root = f"file://{tmp_path}/snap"
    with pytest.raises(snapshots.SnapshotError):
        snapshots.active(spark, root)
    first = spark.createDataFrame([(1, "007", None), (2, "", "x")], "row_number long, a string, b string")
    assert snapshots.publish(first, root) == 1
    broken = first.withColumn("a", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception):  # noqa: B017
        snapshots.publish(broken, root)
    assert sorted(map(tuple, snapshots.active(spark, root).collect())) == [(1, "007", None), (2, "", "x")]
    assert snapshots.publish(first.limit(1), root) == 2 and snapshots.active(spark, root).count() == 1
    assert snapshots.checksum(first).first() == snapshots.checksum(first.orderBy(F.desc("row_number"))).first()


def test_bounded_sources_refuse(spark):
    with pytest.raises(tables.TooLarge):
        tables.bounded(spark.range(11), 10)
    assert tables.bounded(spark.range(10), 10).count() == 10
    with pytest.raises(ValueError):
        tables.jdbc_table(spark, "jdbc:none", "secret", {"open"})
    assert one(spark, tables.cell_text(F.lit("a\0b"), T.StringType())) == "a�b"


def test_reconcile(spark):
    known = [("a", "1", 0, None), ("b", "1", 0, None), ("c", "1", 1, "2024-01-01 00:00:00"), ("d", "1", 1, "2024-01-09 20:00:00"), ("e", "1", 0, None), ("f", "1", 2, "2024-01-01 00:00:00")]
    k = spark.createDataFrame(known, "path string, etag string, misses int, m string").selectExpr("path", "etag", "cast(null as timestamp) mtime", "1 size", "misses", "cast(m as timestamp) missing_since")
    r = spark.createDataFrame([("a", "1"), ("b", "2"), ("f", "1"), ("n", "1")], "path string, etag string").selectExpr("path", "etag", "cast(null as timestamp) mtime", "1 size")
    got = {x.path: x.state for x in relations.reconcile(k, r, F.lit("2024-01-10 00:00:00").cast("timestamp")).collect()}
    assert got == {"a": "unchanged", "b": "changed", "c": "missing", "d": "suspected_missing", "e": "suspected_missing", "f": "restored", "n": "discovered"}


def test_hierarchy():
    assert relations.hierarchy(0) == [] and relations.hierarchy(1) == [(1, 0, 0, 0)]
    assert [x for x in relations.hierarchy(9) if x[0] == 1] == [(1, 0, 0, 3), (1, 1, 4, 7), (1, 2, 8, 8)] and relations.hierarchy(9)[-1] == (2, 0, 0, 8)


def test_table_rows(spark):
    frame = spark.createDataFrame([("行 3｜a=1｜b=x=y｜c=",)], "line string").select(profile.table_rows(F.col("line")).alias("r"))
    row = frame.first()["r"]
    assert row["row_number"] == 3 and row["values"] == {"a": "1", "b": "x=y", "c": ""}


def test_global_rank(spark):
    rows = [r.rank for r in global_rank(spark.range(1000).repartition(7), "id").orderBy("id").collect()]
    assert rows == list(range(1000))


def test_global_rank_of_many_rows_with_a_payload(spark):
    rows = spark.range(1_000_000).select(F.xxhash64("id").alias("key"), F.concat(F.lit("payload "), F.col("id").cast("string")).alias("payload"))
    ranked = global_rank(rows, "key")
    before = F.lag("key").over(Window.partitionBy(F.floor(F.col("rank") / 5000)).orderBy("rank"))
    found = ranked.withColumn("rises", F.coalesce(before < F.col("key"), F.lit(True))).agg(F.count_distinct("rank").alias("n"), F.min("rank").alias("lo"), F.max("rank").alias("hi"), F.bool_and("rises").alias("rises")).first()
    assert tuple(found) == (1_000_000, 0, 999_999, True)
    assert spark.createDataFrame([], "key long").transform(lambda df: global_rank(df, "key")).count() == 0


@pytest.mark.parametrize("cell, want", [("2024-05-06", "2024-05-06"), ("2024/5/6", "2024-05-06"), (" 2024-05-06 ", "2024-05-06"), ("2024", None), ("2024-05", None), ("2024-02-30", None), ("x", None), (None, None)])
def test_dates_need_a_day(spark, cell, want):
    got = one(spark, typed.date(F.lit(cell).cast("string")))
    assert (got and str(got)) == want


def test_html_skips_what_is_no_content(spark):
    page = "<p>a<button>no</button>b</p><aside><p>kept</p></aside><nav><p>no</p></nav><form><input><p>no</p></form><video><p>no</p></video><p>c<input>d</p><canvas><p>no</p></canvas><p>end</p>"
    rows = html.html_blocks(spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")).collect()
    assert [r.text for r in rows] == ["ab", "kept", "cd", "end"]


def test_snapshot_changes(spark):
    old, new = (spark.createDataFrame(r, "k long, v string") for r in ([(1, "a"), (2, None), (3, "c")], [(1, "a"), (2, ""), (4, "d")]))
    assert {r.k: r.state for r in snapshots.changes(old, new, "k").collect()} == {1: "unchanged", 2: "changed", 3: "removed", 4: "added"}


def test_temporary_tables_go_but_those_that_are_kept(spark):
    with store.temporary(spark) as keep:
        gone, stays = store.written(spark.range(3), "gone"), store.written(spark.range(4), "stays")
        keep.append(stays)
    assert stays.count() == 4
    with pytest.raises(Exception):
        spark.read.schema(gone.schema).parquet(gone.inputFiles()[0]).count()


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source, out, check = (f"{tmp_path}/{n}" for n in ("in", "out", "check"))
    events.where("event_id < 40").write.parquet(source)
    read = lambda: jobs.first_of_key(spark.readStream.schema(events.schema).parquet(source).withColumn("ts", F.col("ts").cast("timestamp")), "60 days")
    jobs.run_to(read(), out, check)
    before = spark.read.parquet(out).count()
    events.where("event_id >= 40").write.mode("append").parquet(source)
    jobs.run_to(read(), out, check)
    keys = events.select("event_type", "user_id").distinct().count()
    assert before < spark.read.parquet(out).count() == keys


def test_evidence_helpers(spark):
    from lodestone.operators import evidence

    assert evidence.overlap("abcdef", "efgh") == 2 and evidence.overlap("a", "b") == 0
    rows = spark.createDataFrame([(1, 0, 1, "one two"), (1, 1, 2, "two three"), (1, 2, 3, "fin")], "document_id long, place long, chunk_id long, content string")
    got = {r.chunk_id: r.context for r in evidence.merged_neighbours(rows).collect()}
    assert got[2] == "one two three\n\nfin" and got[1] == "one two three"
    assert evidence.next_profile_state("ready", "active", missing=3) == "building" and evidence.next_profile_state("ready", "active") == "active"
    with pytest.raises(ValueError):
        evidence.next_profile_state("draft", "active")
    pairs = spark.createDataFrame([(k, [1.0, 0.0], other) for k, other in ((1, [2.0, 0.0]), (2, [2.0, 0.0]), (2, [0.0, 1.0]), (4, [1.0, 0.0]), (5, [1.0, 0.0]))], "k int, e array<double>, other array<double>")
    profiles = spark.createDataFrame([(1, False, True), (2, False, True), (3, False, True), (4, False, False), (5, True, False)], "k int, same_fingerprint boolean, same_shape boolean")
    assert {r.k: r.verdict for r in evidence.compatibility(pairs, profiles, ["k"]).collect()} == {1: "compatible", 2: "rebuild_required", 3: "unknown", 4: "rebuild_required", 5: "same"}


def test_filters_and_citations_by_hand(spark):
    rows = spark.createDataFrame([(1, [1, 2, 3], [3, 2, 9]), (2, None, [1, 5]), (3, [1, 2], None), (4, [1], [2]), (5, None, None)], "k int, a array<int>, b array<int>")
    assert [r[0] for r in rows.orderBy("k").select(relations.merge_filters(F.col("a"), F.col("b"))).collect()] == [[2, 3], [1, 5], [1, 2], [], None]
    numbers = lambda *x: F.array(*[F.lit(v) for v in x])
    assert one(spark, relations.filter_ids(numbers(9, 2, 1, 2, -4))) == [1, 2, 9]
    assert one(spark, relations.filter_names(numbers("src2", "src1", "src2"))) == ["src1", "src2"]
    assert one(spark, evidence.uncited(numbers("1", "9"), numbers("1"))) == ["9"]


@pytest.mark.parametrize("ends, valid", [([2, 5, 9], True), ([2, 2, 9], False), ([2, 5], False), ([], False)])
def test_boundaries(spark, ends, valid):
    assert one(spark, evidence.valid_boundaries(F.lit(ends).cast("array<int>"), F.lit(9))) == valid


def test_bytes_of_several_encodings(spark):
    rows = spark.createDataFrame([(1, "数据".encode()), (2, "数据".encode("gb18030")), (3, b"\xef\xbb\xbfbom"), (4, None)], "k int, raw binary")
    assert [r[0] for r in rows.orderBy("k").select(evidence.decoded("raw")).collect()] == ["数据", "数据", "bom", None]


def test_news_outputs_and_candidates(spark):
    steps = spark.createDataFrame([("r", 1, "a"), ("r", 1, "b"), ("r", 2, "b"), ("r", 2, "c"), ("r", 3, "a")], "run string, step int, key string")
    news = relations.new_information(steps, ["run"], ["step"], "key")
    assert sorted((r.step, r.key) for r in news.collect()) == [(1, "a"), (1, "b"), (2, "c")]
    said = spark.createDataFrame([(k, t) for k, t in enumerate(['{"k": 1}', '{"k": "1"}', '{"k": 1, "x": 2}', "{}", "{", None])], "k int, t string")
    verdicts = [r[0] for r in said.orderBy("k").select(relations.output_verdict(F.col("t"), "OBJECT<k: BIGINT>")).collect()]
    assert verdicts == ["ok", "wrong_shape", "wrong_shape", "wrong_shape", "not_json", "not_json"]


def test_page_safe_blocks_and_source_spans(spark):
    rows = spark.createDataFrame([(1, 0, "heading"), (1, 1, "table"), (2, 0, "heading"), (3, 0, "heading")], "document_id long, place long, kind string")
    quality = spark.createDataFrame([(1, "fallback"), (2, "review")], "document_id long, verdict string")
    assert sorted((r.document_id, r.place, r.kind) for r in chunking.page_safe(rows, quality).collect()) == [(1, 0, "paragraph"), (1, 1, "table"), (2, 0, "heading"), (3, 0, "heading")]
    texts = {1: "abcdefg\nh. ij", 2: "x" * 25, 3: "", 4: None, 5: "abcde. fgh\n", 6: "數。" * 8, 7: "abcd. efgh\n"}  # in 7 the sentence ends with the first half
    docs = spark.createDataFrame(list(texts.items()), "document_id long, text string")
    found = {}
    for r in chunking.source_spans(docs, 10).orderBy("document_id", "span").collect():
        found.setdefault(r.document_id, []).append((r.begin, r.end))
    assert found == {1: [(0, 8), (8, 13)], 2: [(0, 10), (10, 20), (20, 25)], 5: [(0, 6), (6, 11)], 6: [(0, 10), (10, 16)], 7: [(0, 10), (10, 11)]}


def test_an_empty_refresh_keeps_the_version_before(spark, tmp_path):
    root, rows = f"file://{tmp_path}/kept", spark.range(3).select(F.col("id").cast("string").alias("id"))
    assert [snapshots.refresh(r, root) for r in (rows, rows.limit(0))] == ["published", "kept"]
    assert snapshots.active(spark, root).count() == 3


def test_html_is_handed_on_before_a_batch_ends():
    batch = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array([f"<p>text {k}</p>" for k in range(99)] + [None])], ["page_id", "html"])
    found = list(html._parsed(iter([batch])))
    assert len(found) == -(-100 // html.AT_ONCE) > 1
    assert [tuple(r.values()) for b in found for r in b.to_pylist()] == [(k, 0, "paragraph", 0, f"text {k}") for k in range(99)]


@pytest.mark.parametrize("ids", [[0, 1, 2, 3, 4], [0, 0, None, None, 4]])
def test_lines_of_words_are_made_where_the_text_is(spark, tmp_path, ids):
    from lodestone.operators.q_documents import ocr_line_aggregate

    texts = ["a  bb " * 9, "", "one", None, " ".join(f"w{k}" for k in range(230))]
    spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = ocr_line_aggregate(spark, str(tmp_path))
    assert ("Exchange" in rows._jdf.queryExecution().executedPlan().toString()) == (len(set(ids)) < len(ids))
    want = {}
    for own, t in zip(ids, texts):
        for i, w in enumerate(t.split(" ") if t is not None else []):
            want.setdefault((own, i // 8), []).append((i, w))
    made = {k: (" ".join(w for _, w in sorted(v)), 0, max(i % 8 * 10 + len(w) for i, w in v), round(sum(i % 100 for i, _ in v) / len(v), 4)) for k, v in want.items()}
    assert {(r.doc_id, r.line): (r.text, r.x0, r.x1, r.confidence) for r in rows.collect()} == made
