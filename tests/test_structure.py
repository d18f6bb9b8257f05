"""Sections, children, overlaps, windows and candidates against a second implementation, which goes through one document after the other."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.operators import q_structure
from lodestone.operators import structure as S

SF = "/root/testdata/sf0.01"
SCHEMA = "document_id long, place long, kind string, level int, page int, text string"


def cut_sentences(text):
    found, own = [], ""
    for k, c in enumerate(text):
        own += c
        if c in "。！？!?；;" or c == "." and text[k + 1 : k + 2].isspace():
            found.append(own)
            own = ""
    return [x.strip() for x in [*found, own] if x.strip()] or [text.strip()]


def merge(pieces, target, least, gap=" "):
    out = []
    for piece in pieces:
        if out and len(out[-1]) + len(gap) + len(piece) <= target:
            out[-1] += gap + piece
        else:
            out.append(piece)
    if len(out) > 1 and len(out[-1]) < least:
        last = out.pop()
        out[-1] += gap + last
    return out


def cut_text(text, z):
    if len(text) <= z.hard:
        return [text]
    paragraphs = [p.strip() for p in re.split(r"\n\s*\n", text) if p.strip()]
    if len(paragraphs) > 1:
        return merge([x for p in paragraphs for x in cut_text(p, z)], z.pack, z.least)
    found = cut_sentences(text)
    return merge(found, z.pack, z.least) if len(found) > 1 else [text[i : i + z.hard] for i in range(0, len(text), z.hard)]


def cut_rows(text, z):
    rows = [r for r in re.split(r"\r?\n", text) if r.strip()]
    if len(rows) < 2:
        return [text[i : i + z.hard] for i in range(0, len(text), z.hard)]
    out, buffer = [], []
    for row in rows:
        if len(row) > z.hard:
            out += merge(buffer, z.pack, 0, "\n")
            buffer = []
            m = re.match(r"行\s+\d+｜", row)
            name = m[0] if m else ""
            n = z.hard - 12 - len(name) if m else z.hard
            parts = [row[len(name) :][i : i + n] for i in range(0, len(row) - len(name), n)]
            out += [f"{name}【片段 {k}/{len(parts)}】{x}" for k, x in enumerate(parts, 1)] if m else parts
        else:
            buffer.append(row)
    return out + merge(buffer, z.pack, 0, "\n")


def cut_exact(text, rows, z):
    marks = [m.end() for m in re.finditer(r"\r?\n" if rows else r"\n\s*\n|[。！？!?；;]\s*|[.]\s+", text)]
    at, out = 0, []
    while at < len(text):
        inside = [m for m in marks if at < m <= at + z.pack]
        after = [m for m in marks if at + z.pack < m <= at + z.hard]
        end = len(text) if at + z.hard >= len(text) else max(inside) if inside else min(after) if after else at + z.hard
        if text[at:end].strip():
            out.append((at, text[at:end]))
        at = end
    return out


def children(blocks, z=S.Sizes(), exact=False):
    """blocks: (place, kind, level, page, text) of one document -> rows of its children."""
    at, sections, path = 0, [], {}
    for _, kind, level, page, text in sorted(blocks):
        text = text.strip()
        if not text:
            continue
        head = kind == "heading"
        level = max(level or 1, 1) if head else None
        if head:
            path = {k: v for k, v in path.items() if k < level} | {level: text}
        if not sections or head and level == 1:
            sections.append({"all": [], "body": [], "page": page, "begin": at})
            if not head:
                sections[-1]["body"].append((kind, page, text, at))
        else:
            sections[-1]["body"].append((kind, page, text, at))
        sections[-1]["all"].append(text)
        sections[-1]["path"] = [path[k] for k in sorted(path)]
        at += len(text) + 2
    names = {"list_item": "list", "code_block": "code", "blockquote": "quote"}

    def called(kinds):
        return names.get(kinds[0], kinds[0]) if len(set(kinds)) == 1 else "mixed"

    out = []
    for number, s in enumerate(sections):
        whole, body = "\n\n".join(s["all"]), s["body"]
        found = []
        if body and len(whole) <= z.pack and len({p for _, p, _, _ in body if p is not None}) < 2:
            first = body[0][1]
            found.append((called([k for k, *_ in body]), s["page"] if first is None else first, s["begin"], s["begin"] + len(whole) + 2, whole))
        elif body:
            group = []

            def flush():
                if group:
                    page = group[0][1]
                    found.append((called([k for k, *_ in group]), s["page"] if page is None else page, group[0][3], group[-1][3] + len(group[-1][2]), "\n\n".join(t for _, _, t, _ in group)))
                    group.clear()

            for kind, page, text, begin in body:
                own = s["page"] if page is None else page
                if len(text) > z.hard:
                    flush()
                    if exact:
                        found += [(kind, own, begin + k, begin + k + len(x), x) for k, x in cut_exact(text, kind in ("table", "code_block"), z)]
                    else:
                        since = begin
                        for x in cut_rows(text, z) if kind == "table" else cut_text(text, z):
                            found.append((kind, own, since, since + len(x), x))
                            since += len(x) + 2
                    continue
                moved = group and page is not None and group[0][1] is not None and page != group[0][1]
                if group and (moved or sum(len(t) + 2 for _, _, t, _ in group) + len(text) > z.pack):
                    flush()
                group.append((kind, page, text, begin))
            flush()
        out += [(number, k, *row, tuple(s["path"])) for k, row in enumerate(found)]
    return out


def tail(text, most):
    picked = []
    if most <= 0:
        return ""
    for x in reversed(cut_sentences(text)):
        if not picked and len(x) > most:
            return x[-most:].strip()
        if len(" ".join([x, *picked])) > most:
            break
        picked.insert(0, x)
    return " ".join(picked)


def overlapped(rows, z=S.Sizes()):
    out = []
    for before, row in zip([None, *rows], rows):
        number, k, kind, page, begin, end, text, path = row
        carried = tail(before[6], min(z.overlap, max(0, z.most - len(text) - 2))) if before and before[0] == number else ""
        out.append((number, k, max(before[4], before[5] - len(carried)) if carried else begin, end, begin, end, len(carried), f"{carried}\n\n{text}" if carried else text))
    return out


def documents():
    """Documents of all kinds of blocks: headings of several levels, pages or none, long and short blocks."""
    rng = random.Random(7)
    word = lambda: rng.choice(["alpha", "beta", "数据分析", "gamma-delta", "x", "über"])
    sentence = lambda: " ".join(word() for _ in range(rng.randint(1, 20))) + rng.choice([". ", "! ", "? ", "。", "；", "?!", " "])
    docs = {}
    for d in range(60):
        blocks, page = [], 1 if d % 3 else None
        for place in range(rng.randint(1, 40)):
            if page and rng.random() < 0.1:
                page += 1
            kind = rng.choices(["paragraph", "heading", "table", "list_item", "code_block", "blockquote"], [8, 3, 2, 2, 1, 1])[0]
            many = rng.choice([0, 1, 1, 2, 5, 30])
            text = "".join(sentence() for _ in range(many))
            if kind == "heading":
                text = word() * rng.randint(1, 3)
            elif kind == "table":
                text = "\n".join(f"行 {k}｜{sentence()}" * rng.choice([1, 1, 40]) for k in range(rng.choice([1, 3, 30])))
            elif rng.random() < 0.2:
                text = text + "\n\n" + "".join(sentence() for _ in range(10)) + "\n \n" + text
            elif rng.random() < 0.05:
                text = "z" * 2000
            blocks.append((place, kind, rng.choice([1, 1, 2, 3, None]) if kind == "heading" else None, page, rng.choice(["", " ", "\n"]) + text))
        docs[d] = blocks
    docs[100] = [(0, "heading", 1, 1, "Alone")]
    docs[101] = [(0, "paragraph", None, None, "  ")]
    docs[102] = [(0, "paragraph", None, None, None), (1, "heading", 4, None, "Deep"), (2, "heading", 2, None, "Less deep"), (3, "paragraph", None, None, "Text.")]
    return docs


@pytest.fixture(scope="module")
def made(spark):
    docs = documents()
    return docs, spark.createDataFrame([(d, *b) for d, own in docs.items() for b in own], SCHEMA).cache()


def plain(docs):
    return {d: [(p, k, lv, pg, t or "") for p, k, lv, pg, t in own] for d, own in docs.items()}


@pytest.mark.parametrize("exact", [False, True])
@pytest.mark.parametrize("sizes", [S.Sizes(), S.Sizes(target=200, most=300, least=40, overlap=50)])
def test_children_equal_a_second_implementation(made, exact, sizes):
    docs, rows = made
    got = sorted((r.document_id, r.section, r.child, r.kind, r.page, r.begin, r.end, r.content, tuple(r.path)) for r in S.children(rows, sizes, exact).collect())
    assert got == sorted((d, *row) for d, own in plain(docs).items() for row in children(own, sizes, exact))


def test_overlaps_equal_a_second_implementation(made):
    docs, rows = made
    for sizes in (S.Sizes(), S.Sizes(target=150, most=160, least=40, overlap=80)):
        found = S.with_overlap(S.children(rows, sizes), sizes)
        got = sorted((r.document_id, r.section, r.child, r.begin, r.end, r.core_begin, r.core_end, r.overlap, r.content) for r in found.collect())
        assert got == sorted((d, *row) for d, own in plain(docs).items() for row in overlapped(children(own, sizes), sizes))


def test_exempt_children_carry_nothing(made):
    rows = S.with_overlap(S.children(made[1]), exempt=F.col("kind") == "table")
    assert rows.where("kind = 'table' and overlap > 0").isEmpty() and not rows.where("kind <> 'table' and overlap > 0").isEmpty()


def test_children_of_all_pages_equal_a_second_implementation(spark):
    rows = q_structure.page_blocks(spark, SF).collect()
    docs = {}
    for r in rows:
        docs.setdefault(r.document_id, []).append((r.place, r.kind, r.level, r.page, r.text))
    got = q_structure.page_children(spark, SF).collect()
    want = {(d, *x[:2]): (*x[2:], y[5]) for d, own in docs.items() for x, y in zip(overlapped(children(own)), children(own))}
    assert {(r.document_id, r.section, r.child): r.content for r in got} == {k: v[5] for k, v in want.items()}
    assert len({r.section for r in got}) > 1 or max(len(r.path) for r in got) > 0


def test_parents_hold_their_section(made):
    docs, rows = made
    for r in S.parents(rows).collect():
        assert r.begin <= r.end - 2 and (r.truncated or len(r.content) == r.end - r.begin - 2)
    long = [(0, "paragraph", None, None, "a" * 50_000), (1, "paragraph", None, None, "b" * 50_000)]
    p = S.parents(rows.sparkSession.createDataFrame([(1, *b) for b in long], SCHEMA)).collect()
    assert len(p) == 1 and p[0].truncated and len(p[0].content) == S.PARENT and p[0].content[0] == "a" and p[0].content[-1] == "b"


def test_exact_children_and_parents_prove_the_source(made):
    docs, rows = made
    repaired = S.structural_candidate(rows, S.children(rows)).collect()
    shortened = {r.document_id for r in S.parents(rows).where("truncated").collect()}  # their headings stand in no child
    assert repaired and all(r.unverified == 0 and (r.missing == 0 or r.document_id in shortened) for r in repaired)
    cut = S.children(rows, exact=True).where("content not like '%beta%'").select("document_id", "begin", "content")
    found = {r.document_id: r for r in S.coverage(cut, S.source_texts(rows)).collect()}
    for d, own in plain(docs).items():
        if d in found:
            text = "\n\n".join(t.strip() for *_, t in sorted(own) if t.strip())
            held = set()
            for _, _, _, _, begin, _, content, _ in children(own, exact=True):
                if "beta" not in content:
                    assert text[begin : begin + len(content)] == content
                    held |= set(range(begin, begin + len(content)))
            assert found[d].missing == sum(not c.isspace() for k, c in enumerate(text) if k not in held) and found[d].twice == found[d].unverified == 0


def test_a_candidate_is_split_once_and_shuffled_by_document_alone(made):
    rows = made[1]
    plan = S.structural_candidate(rows, S.with_overlap(S.children(rows)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [spans(") == 1 and "hashpartitioning(document_id" in plan and not re.search(r"hashpartitioning\(document_id#\w+, section", plan)


def test_tails_of_texts_with_much_white_space(spark):
    rng = random.Random(5)
    part = lambda: rng.choice(["a", "bc", "d" * 30, ".", "。", "?!", " ", " " * 50, "\n" * 9, "ü"])
    cases = [("".join(part() for _ in range(rng.randint(0, 40))), rng.choice([0, 1, 2, 7, 40, 120])) for _ in range(1500)]
    got = [r.t for r in spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, x string, m int").select("k", S.semantic_tail(F.col("x"), F.col("m")).alias("t")).orderBy("k").collect()]
    assert got == [tail(*c) for c in cases]


def test_coverage_of_a_text_of_many_parts(spark):
    text = "".join(f"wört {k}. " for k in range(2 * S.PART))
    spans = [(0, 0, text[:5]), (0, 3, text[3:9000]), (0, 9000, text[9000:9000 + S.PART]), (0, S.PART * 11, text[S.PART * 11:]), (0, S.PART * 4, "other"), (0, len(text), "beyond"), (0, -3, text[-4:]), (1, 0, "a")]
    sources = spark.createDataFrame([(0, text), (1, ""), (2, "ab c")], "document_id long, text string")
    got = {r.document_id: r for r in S.coverage(spark.createDataFrame(spans, "document_id long, begin long, content string"), sources).collect()}
    solid = lambda x: len("".join(x.split()))
    assert got[0].chars == solid(text) and got[0].missing == solid(text[9000 + S.PART:S.PART * 11]) and got[0].twice == solid(text[3:5]) and got[0].unverified == 3
    assert (got[1].chars, got[1].unverified) == (0, 1) and (got[2].missing, got[2].unverified) == (3, 0)


def test_windows_of_candidates_are_made_once(spark):
    plan = q_structure.candidate_build(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "windows(" not in plan and "posexplode(split(text" not in plan


# windows


def windows(blocks, chars, many):
    out, own = [], []
    for b in [b for b in sorted(blocks) if b[4].strip()]:
        edge = own and (b[1] == "heading" and (b[2] or 1) <= 1 or b[3] != own[0][3])
        full = own and (sum(len(x[4]) + 2 for x in own) + len(b[4]) > chars or len(own) >= many)
        if edge or full and "table" not in (b[1], own[-1][1]):
            out.append(own)
            own = []
        own.append(b)
    return out + [own] if own else out


@pytest.mark.parametrize("chars, many", [(6000, 32), (500, 4), (40, 2)])
def test_windows_equal_a_second_implementation(made, chars, many):
    docs, rows = made
    got = sorted((r.document_id, r.window, r.place) for r in S.window_numbers(rows, chars, many).collect())
    assert got == sorted((d, k, b[0]) for d, own in plain(docs).items() for k, w in enumerate(windows(own, chars, many)) for b in w)


@pytest.mark.parametrize("chars, many", [(6000, 32), (100, 3), (60, 64)])
def test_segments_hold_every_character_once(made, chars, many):
    docs, rows = made
    got = {}
    for r in S.source_segments(rows, chars, many).collect():
        got.setdefault(r.document_id, []).append(r)
    for d, own in plain(docs).items():
        blocks = {b[0]: b for b in own if b[4].strip()}
        found = sorted(got.get(d, []), key=lambda r: (r.window, r.segment))
        assert [(r.place, r.start) for r in found] == sorted((r.place, r.start) for r in found)
        assert {p: "".join(b[4][r.start : r.stop] for r in found if r.place == p) for p, b in list(blocks.items())[:10]} == {p: b[4] for p, b in list(blocks.items())[:10]}
        assert sum(r.stop - r.start for r in found) == sum(len(b[4]) for b in blocks.values())
        by_window = {}
        for r in found:
            by_window.setdefault(r.window, []).append(r)
        assert list(by_window) == list(range(len(by_window)))
        for w, inside in by_window.items():
            assert [r.segment for r in inside] == list(range(len(inside))) and len(inside) <= many and sum(r.stop - r.start for r in inside) <= chars
            assert all(blocks[r.place][1] != "heading" or r.start > 0 for r in inside[1:])
            later = by_window.get(w + 1, [])[:1]
            assert not later or len(inside) == many or sum(r.stop - r.start for r in inside) == chars or blocks[later[0].place][1] == "heading" and later[0].start == 0
        assert all(r.partial == (r.stop - r.start < len(blocks[r.place][4])) for r in found)


def judged(kinds, lengths, ends, chars):
    n = len(kinds)
    if not ends or len(ends) > n:
        return "invalid_count"
    before = -1
    for e in ends:
        if e is None or not before < e < n:
            return "invalid_boundary"
        if sum(x + 2 for x in lengths[before + 1 : e + 1]) > chars:
            return "oversize_group"
        if e < n - 1 and "table" in kinds[e : e + 2]:
            return "table_context_split"
        if e < n - 1 and kinds[e] == "heading":
            return "heading_context_split"
        before = e
    return "valid" if before == n - 1 else "incomplete_coverage"


def test_verdicts_on_groups_have_every_kind(made, spark):
    docs, rows = made
    rng = random.Random(3)
    own = {(d, k): w for d, blocks in plain(docs).items() for k, w in enumerate(windows(blocks, 2000, 8))}
    ends = {}
    for key, w in own.items():
        n = len(w)
        ends[key] = rng.choice([[n - 1], list(range(n)), sorted(rng.sample(range(n), min(n, 2))) + [n - 1], [0, 0], [n], [], [None], [*range(n), n - 1], [max(0, n - 2)], sorted({rng.randrange(n), n - 1})])
    given = spark.createDataFrame([(*k, e) for k, e in ends.items()], "document_id long, window int, ends array<int>")
    got = {(r.document_id, r.window): r.verdict for r in S.judged_groups(S.window_numbers(rows, 2000, 8), given, 1500).collect()}
    assert got == {k: judged([b[1] for b in w], [len(b[4]) for b in w], ends[k], 1500) for k, w in own.items()}
    assert set(got.values()) == {"invalid_count", "invalid_boundary", "oversize_group", "table_context_split", "heading_context_split", "incomplete_coverage", "valid"}


def test_groups_keep_their_blocks(made, spark):
    docs, rows = made
    own = {(d, k): w for d, blocks in plain(docs).items() for k, w in enumerate(windows(blocks, 2000, 8))}
    cuts = {k: [len(w) // 2, len(w) - 1] for k, w in own.items() if k[1] % 2 == 0 and len(w) > 2}
    given = spark.createDataFrame([(*k, e) for k, e in cuts.items()], "document_id long, window int, ends array<int>")
    got = {}
    for r in S.regrouped(S.window_numbers(rows, 2000, 8), given).collect():
        got.setdefault(r.document_id, {}).setdefault(r.group, []).append(r.place)
    want = {}
    for d in {k[0] for k in cuts}:
        groups = []
        loose = None
        for (_, k), w in sorted((x for x in own.items() if x[0][0] == d), key=lambda x: x[0][1]):
            places = [b[0] for b in w]
            if (d, k) in cuts:
                groups += [places[: cuts[d, k][0] + 1], places[cuts[d, k][0] + 1 :]]
                loose = None
            elif loose is None:
                loose = list(places)
                groups.append(loose)
            else:
                loose += places
        want[d] = {k: g for k, g in enumerate(groups)}
    assert {d: {k: sorted(p) for k, p in g.items()} for d, g in got.items()} == want
    text = {r.document_id: r.text for r in S.source_texts(rows).collect()}
    short = {d for d, blocks in plain(docs).items() if all(len(b[4].strip()) <= S.Sizes().hard for b in blocks)}
    checked = [r for r in S.children_of_groups(S.regrouped(S.window_numbers(rows, 2000, 8), given)).collect() if r.document_id in short]
    assert checked and all(text[r.document_id][r.core_begin :].startswith(r.content[r.overlap + 2 if r.overlap else 0 :]) for r in checked)


@pytest.mark.parametrize("text, level, kind", [("ABC 12 DE", None, "paragraph"), ("A数", None, "paragraph"), ("INTRODUCTION", 1, "heading"), ("1.2 SCOPE 7", 2, "heading"), ("3. OVERVIEW 9", 1, "heading"), ("Normal Title", 2, "heading")])
def test_repaired_headings(spark, text, level, kind):
    row = S.repaired_headings(spark.createDataFrame([(1, 0, "heading", 2 if text == "Normal Title" else None, None, text)], SCHEMA)).first()
    assert (row.kind, row.level) == (kind, level)


def test_nothing_gives_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert S.children(none).collect() == S.parents(none).collect() == S.window_numbers(none).collect() == S.source_segments(none).collect() == []


@pytest.mark.parametrize("title, blocks, profile, score, confidence", [
    ("合同", [("paragraph", "甲方 乙方 违约责任 不可抗力")], "contract", 0.9, 0.9), ("x", [("paragraph", "甲方")], "general", 0.0, 1.0), ("摘要 参考文献", [("heading", "DOI")], "paper", 0.75, 0.75),
    ("x", [("paragraph", "甲方 乙方 摘要 关键词")], "general", 0.6, 0.5), ("x", [("code_block", "a"), ("code_block", "b"), ("paragraph", "c")], "code", 0.9, 0.9),
    ("x", [("table", "a"), ("table", "b"), *[("paragraph", "c")] * 6], "table", 0.7, 0.7), ("x", [("paragraph", "z" * 800 + "甲方 乙方 违约责任 不可抗力")], "general", 0.0, 1.0),
    (None, [*[("paragraph", "c")] * 8, ("paragraph", "甲方 乙方 违约责任 不可抗力")], "general", 0.0, 1.0),
])
def test_kinds_of_documents(spark, title, blocks, profile, score, confidence):
    rows = spark.createDataFrame([(1, k, kind, None, None, text) for k, (kind, text) in enumerate(blocks)], SCHEMA)
    got = S.document_profiles(rows, spark.createDataFrame([(1, title)], "document_id long, title string")).first()
    assert (got.profile, got.score, got.confidence) == (profile, score, confidence)


def test_children_go_through_python_twice(spark):
    rows = [(d, 0, "paragraph", None, None, "One two. " * (d % 7 * 60)) for d in range(3 * S.AT_ONCE)] + [(-1, 0, "table", None, None, "a | b\n" * 500)]
    blocks = spark.createDataFrame(rows, "document_id long, place long, kind string, level int, page int, text string")
    made = S.children(blocks)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2
    both = S.split(blocks, S.Sizes(), "text", "text", "a", "b").select("document_id", "a", "b")
    single = S.split_long(blocks, S.Sizes(), "text", "a").join(S.split_rows(blocks, S.Sizes(), "text", "b"), "document_id").select("document_id", "a", "b")
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, single.collect()))
