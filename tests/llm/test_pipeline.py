import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
sys.path.insert(0, str(Path(__file__).parents[2]))
import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from lodestone.llm import decontaminate  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    named = {d: t for d, t in rows.items() if any(c.isalpha() for c in t or "")}
    exact = {}
    for d, t in sorted(named.items()):
        exact[t.encode().translate(brute.UPPER)] = d
    kept = {d: named[d] for d in exact.values()}
    groups = brute.jaccard_groups(list(kept.items()), 5, 80)
    kept = {d: t for d, t in kept.items() if groups[d][1] == d}
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    bad = {r.doc_id for r in decontaminate.contained_items(spark.createDataFrame(list(kept.items()), "doc_id long, text string"), items).collect()}
    assert bad
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in got} == set(kept) - bad
    spans = {}
    for r in got:
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in spans.values():
        assert sum(n for _, n in own) == max(o + n for o, n in own) <= 2048


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    for name, stage in corpus_pipeline.STAGES[:2]:
        assert stage(spark, docs, SF).columns == corpus_pipeline.COLUMNS
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_stages_judge_rows_without_an_id_of_their_own(spark):
    item = next(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len(r.text.split()) > 20)
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    for id_ in (None, 7):
        rows = [(id_, t, None, "s", 1) for t in (a, b, b, b + " more", "12 !!", c + " " + item)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
        left = []
        for _, stage in corpus_pipeline.STAGES[:4]:
            docs = corpus_pipeline.written(stage(spark, docs, SF), "stage")
            assert docs.columns == corpus_pipeline.COLUMNS
            left.append(docs.count())
        assert left == [5, 4, 3, 2]
        kept = docs.collect()
        assert {r.doc_id for r in kept} == {id_} and {r.text[:2] for r in kept} == {"a0", "b0"}
