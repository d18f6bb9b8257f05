import hashlib
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parents[2]))
import corpus_pipeline  # noqa: E402
from lodestone import store  # noqa: E402
from lodestone.llm import chat_format, langid, sampling, url_filter  # noqa: E402

SF = "/root/testdata/sf0.01"


class Captured:
    """Stands for a table; keeps the function that goes to its workers."""

    schema = None

    def mapInArrow(self, run, schema):
        self.run = run


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and len(held) > 150
    assert np.mean([r.lang == r.lang_pred for r in held]) >= 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_cases(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", F.lit("x").alias("score"))
    model = langid.train_on(base)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !! \n"), (None, "the of and that with"), (5, "der die und nicht " * 20000), (5, "der die und nicht")], "doc_id long, text string")
    got = [(r.doc_id, r.lang_pred, r.score > 0) for r in langid.predict(odd, model).collect()]
    assert got[:4] == [(1, "und", False), (2, "und", False), (3, "und", False), (None, "en", True)]
    assert got[4:] == [(5, "de", True)] * 2
    assert langid.predict(odd, None).where("lang_pred <> 'und'").count() == 0
    assert langid.train_on(base.limit(0)) is None and langid.identify(base.limit(0)).count() == 0


def test_training_never_sees_held_out_rows(spark):
    docs = spark.createDataFrame([(k, "aa bb cc " * 5 if k % 2 else "zz yy xx " * 5, "a" if k % 2 else "z") for k in range(80)], "doc_id long, text string, lang string")
    seen = docs.where(~langid.held_out()).count()
    assert 0 < seen < 80
    poisoned = docs.withColumn("lang", F.when(langid.held_out(), "bad").otherwise(F.col("lang")))
    assert langid.train_on(poisoned).langs == ["a", "z"]


def test_threshold_keeps_clean_text():
    scores = [k / 1000 for k in range(999, -1, -1)]
    assert langid.threshold(scores, 0.001) == 0.0 and langid.threshold(scores, 0.01) == 0.009
    assert langid.threshold(scores[:998], 0.001) == 0.0 and langid.threshold([], 0.5) == 0.0


def test_the_score_decides_in_the_pipeline(spark, monkeypatch):
    monkeypatch.setattr(langid, "CLEAN_LOSS", 0.02)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    model = langid.train_on(docs)
    least = langid.least_score(docs, model)
    rows = langid.predict(docs, model).collect()
    held = sorted(r.score for r in rows if r.held_out and r.lang_pred != "und")
    assert least == held[int((len(held) + 1) * 0.02) - 1] > 0
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs, SF).collect()}
    assert kept == {r.doc_id for r in rows if r.lang_pred != "und" and r.score >= least}
    lost = [r for r in rows if r.doc_id not in kept and r.lang_pred != "und"]
    assert 0 < len(lost) <= 0.04 * len(rows)


def test_without_labels_lettered_documents_stay(spark):
    docs = spark.createDataFrame([(1, "the end", None, "s", 7), (2, "12 !!", None, "s", 5), (3, None, None, "s", 0), (None, "élan", None, None, 4)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id or 0 for r in corpus_pipeline.language_id(spark, docs, SF).collect()) == [0, 1]
    only_held = spark.range(60).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(5).alias("n_chars")).where(langid.held_out())
    assert corpus_pipeline.language_id(spark, only_held, SF).count() == only_held.count() > 0


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
URLS = {
    "http://a.example.org/es/1": ("a.example.org", "/es/1", "example.org/es/", "block"),
    "https://EXAMPLE.org/en/123?x#y": ("example.org", "/en/123", "example.org/en/1", "block"),
    "https://example.org/en/2": ("example.org", "/en/2", "org/", "allow"),
    "https://badexample.org/es/1": ("badexample.org", "/es/1", "org/", "allow"),
    "http://x.com/fr/": ("x.com", "/fr/", "com/fr/", "allow"),
    "http://x.com/de/1": ("x.com", "/de/1", "com/de/", "block"),
    "http://x.com/DE/1": ("x.com", "/DE/1", None, "allow"),
    "http://org?/es/": ("org", "", None, "allow"),
    "x.com/de/1": ("", "", None, "allow"),
    "http:///de/": ("", "/de/", None, "allow"),
    "http://a://b.com/de/2": ("a:", "//b.com/de/2", None, "allow"),
    None: ("", "", None, "allow"),
}


def pages(spark):
    return spark.createDataFrame([(k, u, "clash") for k, u in enumerate(URLS)] * 2, "page_id long, url string, host string")


@pytest.mark.parametrize("most", [10_000, 2, 1])
def test_url_verdicts(spark, monkeypatch, most):
    monkeypatch.setattr(url_filter, "PART_KEYS", most)
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.url_verdicts(pages(spark), rules).collect())
    assert got == sorted((k, *v) for k, v in list(enumerate(URLS.values())) * 2)
    assert url_filter.url_verdicts(pages(spark).limit(0), rules).count() == 0
    none = url_filter.url_verdicts(pages(spark), rules.limit(0))
    assert none.where("rule is null and verdict = 'allow'").count() == 2 * len(URLS)


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(20000).select(F.xxhash64("id").alias("h1"), F.xxhash64("id", F.lit(1)).alias("h2"), (F.col("id") % 7 == 0).alias("listed"))
    levels = url_filter.build_cascade(universe)
    rows = universe.toPandas()
    assert len(levels) > 2
    assert (url_filter.member(levels, rows.h1.to_numpy(), rows.h2.to_numpy()) == rows.listed.to_numpy()).all()


TALK = [
    (1, 0, "system", "be <|end|> kind"), (1, 1, "user", "a b c " * 40), (1, 2, "assistant", "ok \\ <|text|> x"), (1, 3, "user", "[INST] \\<s>"), (1, 4, "assistant", "é" * 700),
    (2, 0, "user", "hi"), (2, 1, "assistant", ""), (2, 2, "assistant", None), (2, 3, None, "</s>[INST] ok [/INST]"), (3, 0, "system", "alone"),
    (4, 0, "assistant", "w " * 900), (4, 0, "assistant", "w " * 900), (None, 0, "assistant", "q\nq"), (5, 7, "user", "long " * 20000), (5, 8, "assistant", "<\\|end|>"),
    *[(6, k, "assistant" if k % 2 else "user", f"turn {k} " * (k % 9 + 1)) for k in range(60)],
]


@pytest.mark.parametrize("budget, history", [(1024, 256), (60, 20), (10, 3)])
def test_chat_round_trip(spark, budget, history):
    rows = spark.createDataFrame([(*t, "clash") for t in TALK], "conv_id long, turn long, role string, text string, window string").repartition(3)
    windows = chat_format.windows(rows, budget, history)
    got = {r.conv_id: r for r in chat_format.read_back(windows).collect()}
    chars = {}
    for w in windows.collect():
        chars[w.conv_id] = chars.get(w.conv_id, 0) + len(w.formatted)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for conv in {t[0] for t in TALK}:
        own = sorted(((t[1], t[2] or "", t[3] or "") for t in TALK if t[0] == conv))
        loss = "".join(text for _, role, text in own if role == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(own), sha("".join(f"{role}\n{text}\n" for _, role, text in own)))
        assert (r.loss_chars, r.loss_sha256, r.formatted_chars) == (len(loss), sha(loss), chars[conv])
    assert len(got) == len({t[0] for t in TALK})
    assert chat_format.read_back(chat_format.windows(rows.limit(0))).count() == 0


@pytest.mark.parametrize("budget, history", [(1024, 256), (60, 20), (10, 3)])
@pytest.mark.parametrize("long", [0, 500])
def test_long_conversations_have_the_same_windows(spark, budget, history, long):
    """Conversations that are dealt to many tasks by ranges, all of them or the long ones, have the windows of those in one task."""
    rows = spark.createDataFrame(TALK, "conv_id long, turn long, role string, text string").repartition(3)
    fields = lambda df: sorted(((r.conv_id is None, r.conv_id or 0, r.window, r.n_repeated, r.formatted, r.loss) for r in df.collect()), key=str)
    assert fields(chat_format.windows(rows, budget, history, long)) == fields(chat_format.windows(rows, budget, history))
    assert chat_format.windows(rows.limit(0), budget, history, long).count() == 0


def test_a_conversation_of_many_turns_goes_to_many_tasks(spark):
    rows = spark.range(20000).select(F.lit(1).alias("conv_id"), (F.col("id") % 6000).alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("word "), "id").alias("text"))
    own = chat_format._by_ranges(chat_format._turns(rows), 1024, 256)
    assert own.groupBy("pos").count().count() == 20000 and own.agg(F.max("pos")).first()[0] == 20000
    dealt = spark.read.parquet([p for p in store._made if "/turns-" in p][-1])
    assert dealt.groupBy("range").count().agg(F.max("count")).first()[0] < 2 * 20000 / int(spark.conf.get("spark.sql.shuffle.partitions"))
    got, want = (chat_format.read_back(chat_format.windows(rows, long=n)).first() for n in (0, 1 << 40))
    assert got == want


def test_windows_keep_the_system_turn_and_the_budget(spark):
    rows = spark.createDataFrame(TALK, "conv_id long, turn long, role string, text string")
    own = chat_format.windows(rows, 200, 50).where("conv_id = 1").orderBy("window").collect()
    assert len(own) > 1 and all(w.formatted.startswith("<|turn|>system<|text|>be <\\|end|> kind<|end|>") for w in own)
    many = chat_format.windows(rows, 120, 40).where("conv_id = 6").withColumn("tokens", F.regexp_count("formatted", F.lit(chat_format.TOKEN))).collect()
    assert len(many) > 3 and max(w.tokens for w in many) <= 120
    assert any(w.n_repeated > 0 for w in many)


@pytest.mark.parametrize("text, want", [("½ 12", False), ("² ³ ¹", False), ("Ⅷ", False), ("_ 7 -", False), ("", False), ("1é", True), ("数", True), ("12 ʰ", True)])
def test_letters_are_letters_only(text, want):
    assert langid.has_letter(text) == want
    model = langid.train(["ab cd", "xy zw"] * 8, ["en", "de"] * 8)
    assert (langid.judge([text], model)[0][0] != langid.UNKNOWN) == want


def test_samples_are_the_least_hashes(spark):
    rows = spark.range(20_000).select(F.xxhash64("id").alias("by"), "id")
    hashes = sorted(r.by for r in rows.collect())
    assert [r.by for r in sampling.least_hashes(rows, "by", 20_000, 500).collect()] == hashes[:500]
    assert sampling.least_hashes(rows, "by", 20_000, 30_000).count() == 20_000
    plan = sampling.least_hashes(rows, "by", 20_000, 500)._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter (xxhash64" in plan or "Filter (by" in plan


def test_the_threshold_is_that_of_all_unseen_rows(spark, monkeypatch):
    import random

    rng = random.Random(3)
    for n in (0, 998, 999, 12_000):
        scores = [round(rng.random(), 3 if n == 999 else 9) for _ in range(n)]  # some with many equal ones
        assert langid.threshold_of(spark.createDataFrame([(x,) for x in scores], "score double"), 0.001) == langid.threshold(scores, 0.001)
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"), F.lit("en").alias("lang"))
    monkeypatch.setattr(langid, "predict", lambda rows, model: rows.select("doc_id", F.lit("en").alias("lang_pred"), (F.col("doc_id") / 30_000).alias("score")))
    unseen = [r.doc_id / 30_000 for r in docs.where(langid.held_out()).collect()]
    assert len(unseen) > 7000 and langid.least_score(docs, object()) == langid.threshold(unseen, 0.001)


def test_a_worker_has_a_slice_of_a_batch_at_once(monkeypatch):
    docs, seen = Captured(), []

    def judge(texts, model):
        seen.append(sum(len((t or "").encode()) for t in texts))
        return ["en"] * len(texts), np.ones(len(texts))

    monkeypatch.setattr(langid, "judge", judge)
    monkeypatch.setattr(langid, "SLICE", 100)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(40)), "text": ["é" * 20, None, "", "x" * 150, "a b"] * 8})
    langid.recognised(docs, object(), 0.5)
    assert pa.Table.from_batches(docs.run(iter([batch.slice(1), batch.slice(0, 0)]))).to_pydict() == batch.slice(1).to_pydict()
    assert len(seen) > 10 and max(seen) == 150 and sum(seen) == 8 * (40 + 150 + 3) - 40
