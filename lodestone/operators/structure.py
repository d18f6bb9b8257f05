"""Sections, parents and children of documents made of blocks, with exact places; windows over blocks; candidates and the verdicts on them.

Blocks are rows: document_id, place (their order), kind, level (of a heading), page (may be null) and text; other columns of a document stay out. The text of a document is
that of its non-blank blocks, stripped, with a blank line between; all places are in that text.

What a document has in order is told by windows over (document_id, place); what can only be told one after the other (how units are packed into
groups) is told by ``packer``, which sees the sizes of one section's units as arrays, not their texts. All steps are keyed by document_id first, so one shuffle by
document serves them all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone import store

#: White space that is stripped.
WHITE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0                　"
#: Where a sentence ends: after a full-width mark or one of ! ? ;, and after a full stop with white space behind it.
SENTENCE = r"(?U)(?<=[。！？!?；;])\s*|(?<=\.)\s+"
#: What children of one kind of block are called (fixed values); of several kinds: mixed.
KINDS = {"list_item": "list", "code_block": "code", "blockquote": "quote"}
#: Parents longer than this keep their head and tail; what stands between.
PARENT, ELISION = 80_000, "\n\n…\n\n"
LEVELS = range(1, 7)
#: Characters of a part of a source text.
PART = 1024


@dataclass(frozen=True)
class Sizes:
    """Characters of a child: wanted, at most, at least (of a last piece), and carried over from the child before."""

    target: int = 600
    most: int = 900
    least: int = 80
    overlap: int = 120

    @property
    def pack(self) -> int:
        return max(self.least, self.target - self.overlap)

    @property
    def hard(self) -> int:
        return max(self.least, self.most - self.overlap)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def sentences(text: Column) -> Column:
    """The sentences of a text, stripped; the text itself where there is none."""
    found = F.filter(F.transform(F.split(text, SENTENCE), stripped), lambda s: s != "")
    return let(found, lambda s: F.when(F.size(s) > 0, s).otherwise(F.array(stripped(text))))


def hard_pieces(text: Column, size: int) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s)(.{{1,{size}}})"), F.lit(1))


INTS = pa.list_(pa.int32())
#: Rows of a batch that Python has as lists at once.
AT_ONCE = 256


def _rows(*columns: pa.Array) -> Iterator[tuple]:
    """The rows of columns of equal length, made into Python values a few at a time."""
    for k in range(0, len(columns[0]), AT_ONCE):
        yield from zip(*(c.slice(k, AT_ONCE).to_pylist() for c in columns))


# The functions below are marked as not deterministic so that the optimizer runs them once and where they stand, and never moves them into a lambda or a filter.


def _pack(sizes: list[int], alone: list[bool], pages: list[int], most: int, gap: int, least: int) -> list[int]:
    """Where groups of units begin; as ``packer`` says."""
    starts: list[int] = []
    used = page = -1  # used: of the open group; -1: none is open
    for k, (size, single, at) in enumerate(zip(sizes, alone, pages)):
        moved = at >= 0 and page >= 0 and at != page
        if single or used < 0 or moved or used + size > most:
            starts.append(k)
            used, page = 0, at
        used = -1 if single else used + size + gap
    if len(starts) > 1 and sum(sizes[starts[-1] :]) + gap * (len(sizes) - starts[-1] - 1) < least:
        starts.pop()
    return starts


def packer(most: int, gap: int, least: int = 0) -> Callable[..., Column]:
    """A function of arrays (sizes, alone, pages): where groups of units begin. A unit joins the group before it while their sizes, with a gap after each, stay within
    most; units that stand alone, and those of another page than the group's first (-1: no page), do not. A last group smaller than least goes to the one before it."""

    @F.arrow_udf("array<int>")
    def starts(sizes: pa.Array, alone: pa.Array, pages: pa.Array) -> pa.Array:
        return pa.array((_pack(*own, most, gap, least) for own in _rows(sizes, alone, pages)), INTS)

    return starts.asNondeterministic()


def cascade(sizes: Sizes) -> Callable[..., Column]:
    """A function of arrays (sizes, paragraphs, hard): where pieces begin, of units that are sentences, short paragraphs or, where hard, parts of a fixed size. Sentences
    are packed inside their paragraph, and where there are several paragraphs, what that gives is packed once more."""

    @F.arrow_udf("array<int>")
    def starts(lengths: pa.Array, paragraphs: pa.Array, hard: pa.Array) -> pa.Array:
        out = []
        for n, of, fixed in _rows(lengths, paragraphs, hard):
            begins: list[int] = []
            borders = [k for k in range(len(n)) if not k or of[k] != of[k - 1]] + [len(n)]
            for a, b in zip(borders, borders[1:]):
                begins += list(range(a, b)) if fixed[a] else [a + k for k in _pack(n[a:b], [False] * (b - a), [-1] * (b - a), sizes.pack, 1, sizes.least)]
            if len(borders) > 2:
                ends = begins[1:] + [len(n)]
                whole = [sum(n[a:b]) + b - a - 1 for a, b in zip(begins, ends)]
                begins = [begins[k] for k in _pack(whole, [False] * len(whole), [-1] * len(whole), sizes.pack, 1, sizes.least)]
            out.append(begins)
        return pa.array(out, INTS)

    return starts.asNondeterministic()


def runs(units: Column, starts: Column) -> Column:
    """The units as an array of arrays, each from one start up to the next."""
    return F.transform(starts, lambda a, k: F.slice(units, a + 1, F.coalesce(F.get(starts, k + 1), F.size(units)) - a))


def _in_order(columns: list[str], by: str) -> Column:
    return F.array_sort(F.collect_list(F.struct(by, *columns)))


# sections and parents


def outlined(blocks: DataFrame) -> DataFrame:
    """The non-blank blocks, stripped, with where they begin, their section (from 0) and the headings above them, outermost first. A section begins with the document and
    with each heading of the first level; a heading of a deeper level stays inside, and only begins one where it is the document's first block."""
    rows = blocks.select("document_id", "place", "kind", F.when(F.col("kind") == "heading", F.greatest(F.coalesce("level", F.lit(1)), F.lit(1))).alias("level"), "page", stripped(F.col("text")).alias("text")).where("text <> ''")
    order = Window.partitionBy("document_id").orderBy("place")
    upto, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    opens = (F.col("level") == 1) | (F.row_number().over(order) == 1)
    path = []
    for k in LEVELS:
        here = F.last(F.when(F.col("level") == k, F.struct("place", "text")), ignorenulls=True).over(upto)
        above = F.max(F.when(F.col("level") < k, F.col("place"))).over(upto)
        path.append(F.when(here["place"] > F.coalesce(above, here["place"] - 1), here["text"]))
    begin = F.coalesce(F.sum(F.length("text") + 2).over(before), F.lit(0))
    rows = rows.withColumns({"begin": begin, "section": F.count_if(F.coalesce(opens, F.lit(False))).over(upto) - 1, "path": F.array_compact(F.array(*path))})
    return rows


def sections(blocks: DataFrame) -> DataFrame:
    """A row a section: document_id, section, path, page, begin, end, chars, head (its heading, or null) and body (its other blocks in order). The end counts the
    blank line behind the section."""
    fields = ["kind", "level", "page", "begin", "text", "path"]
    s = outlined(blocks).groupBy("document_id", "section").agg(_in_order(fields, "place").alias("b"))
    first = F.get("b", F.lit(0))
    headed = first["kind"] == "heading"
    chars = F.aggregate("b", F.lit(-2), lambda n, x: n + F.length(x["text"]) + 2)
    body = F.when(headed, F.slice("b", 2, F.greatest(F.size("b") - 1, F.lit(1)))).otherwise(F.col("b"))
    s = s.select("document_id", "section", F.get("b", F.size("b") - 1)["path"].alias("path"), first["page"].alias("page"), first["begin"].alias("begin"), chars.alias("chars"), F.when(headed, first).alias("head"), body.alias("body"), "b")
    return s.withColumn("end", F.col("begin") + F.col("chars") + 2)


def _joined(blocks: Column) -> Column:
    return F.array_join(F.transform(blocks, lambda x: x["text"]), "\n\n")


def parent_id(document: str = "document_id", section: str = "section") -> Column:
    return F.concat_ws(":p:", F.col(document).cast("string"), F.col(section).cast("string"))  # a struct is written out


def parents(blocks: DataFrame) -> DataFrame:
    """A row a section: document_id, section, parent_id, path, page, begin, end, content (bounded) and truncated."""
    text = _joined(F.col("b"))
    room = PARENT - len(ELISION)
    cut = F.concat(F.substring(text, 1, room // 2), F.lit(ELISION), F.right(text, F.lit(room - room // 2)))
    long = F.col("chars") > PARENT
    return sections(blocks).select("document_id", "section", parent_id().alias("parent_id"), "path", "page", "begin", "end", F.when(long, cut).otherwise(text).alias("content"), long.alias("truncated"))


# children


def split(rows: DataFrame, sizes: Sizes, prose: str | None = None, table: str | None = None, of_prose: str = "pieces", of_table: str = "pieces") -> DataFrame:
    """rows with of_prose, the pieces of the column prose (as ``split_long`` says), and of_table, those of the column table (as ``split_rows`` says). Both go through Python at once."""
    units = ({"prose_units": prose_units(prose, sizes)} if prose else {}) | ({"table_units": table_units(table, sizes)} if table else {})
    rows = rows.withColumns(units)
    each = lambda column, name: F.transform(column, lambda u: u[name])
    sized = lambda column: F.transform(column, lambda u: F.length(u["text"]))
    starts = {"prose_starts": cascade(sizes)(sized("prose_units"), each("prose_units", "p"), each("prose_units", "hard"))} if prose else {}
    if table:
        starts["table_starts"] = packer(sizes.pack, 1)(sized("table_units"), each("table_units", "alone"), F.transform("table_units", lambda u: F.lit(-1)))
    rows = rows.withColumns(starts)
    joined = lambda name, gap: F.transform(runs(F.col(f"{name}_units"), F.col(f"{name}_starts")), lambda r: F.array_join(each(r, "text"), gap))
    found = ({of_prose: joined("prose", " ")} if prose else {}) | ({of_table: joined("table", "\n")} if table else {})
    return rows.withColumns(found).drop(*units, *starts)


def split_long(rows: DataFrame, sizes: Sizes, text: str = "text", pieces: str = "pieces") -> DataFrame:
    """rows with pieces, an array of texts, of the column text. One within the hard limit is one piece. A longer one is cut at blank lines, a paragraph that is too long at sentences, and what has one sentence
    into parts of the limit. Sentences and paragraphs are joined again by a space while they stay within the target, and a last piece that is too short goes to the one before; a
    single sentence longer than the limit stays whole, as long as there are others."""
    return split(rows, sizes, prose=text, of_prose=pieces)


def prose_units(text: str, sizes: Sizes) -> Column:
    """The parts (text, number of the paragraph, whether of a fixed size) that pieces are made of."""
    short = F.length(text) <= sizes.hard
    paragraphs = F.filter(F.transform(F.split(text, r"(?U)\n\s*\n"), stripped), lambda p: p != "")
    paragraphs = F.when(short, F.array(text)).otherwise(let(paragraphs, lambda p: F.when(F.size(p) > 1, p).otherwise(F.array(text))))

    def unit(p: Column, k: Column) -> Column:
        whole = lambda texts, hard: F.transform(texts, lambda x: F.struct(x.alias("text"), k.alias("p"), F.lit(hard).alias("hard")))
        return F.when(F.length(p) <= sizes.hard, whole(F.array(p), False)).otherwise(let(sentences(p), lambda s: F.when(F.size(s) > 1, whole(s, False)).otherwise(whole(hard_pieces(p, sizes.hard), True))))

    return F.flatten(F.transform(paragraphs, unit))


def split_rows(rows: DataFrame, sizes: Sizes, text: str = "text", pieces: str = "pieces") -> DataFrame:
    """rows with pieces, an array of texts, of table texts in the column text: rows packed up to the target; a row beyond the limit is cut by itself into parts, each of which names it where it begins with its number; a single row is cut into parts of the limit."""
    return split(rows, sizes, table=text, of_table=pieces)


def table_units(text: str, sizes: Sizes) -> Column:
    """The parts (text, and whether it stands alone) that pieces of table texts are made of."""
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: stripped(x) != "")

    def unit(line: Column) -> Column:
        name = F.regexp_extract(line, r"^(行\s+\d+｜)", 1)
        size = F.greatest(F.lit(1), F.lit(sizes.hard - 12) - F.length(name))
        body = F.substring(line, F.length(name) + 1, F.length(line))
        k = F.ceil(F.length(body) / size).cast("int")
        named = F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.concat(name, F.lit("【片段 "), (i + 1).cast("string"), F.lit("/"), k.cast("string"), F.lit("】"), F.substring(body, i * size + 1, size)))
        each = lambda texts, alone: F.transform(texts, lambda x: F.struct(x.alias("text"), F.lit(alone).alias("alone")))
        return F.when(F.length(line) <= sizes.hard, each(F.array(line), False)).when(name != "", each(named, True)).otherwise(each(hard_pieces(line, sizes.hard), True))

    only = F.transform(hard_pieces(F.col(text), sizes.hard), lambda x: F.struct(x.alias("text"), F.lit(True).alias("alone")))  # one row has no name to repeat
    return F.when(F.size(lines) > 1, F.flatten(F.transform(lines, unit))).otherwise(only)


def exact_spans(sizes: Sizes) -> Callable[..., Column]:
    """A function of (text, rows): the spans (since, text) into which a text is cut without a gap, but for those of white space alone. A span ends at the last place for it (a blank line or
    sentence; a line for rows) within the target, else at the first one within the limit, else at the limit."""
    import re
    from bisect import bisect_right

    marks = {True: re.compile(r"\r?\n"), False: re.compile(r"\n\s*\n|[。！？!?；;]\s*|[.]\s+")}

    @F.arrow_udf("array<struct<since:int,text:string>>")
    def spans(texts: pa.Array, by_rows: pa.Array) -> pa.Array:
        return pa.array((_spans(*own) for own in _rows(texts, by_rows)), pa.list_(pa.struct([("since", pa.int32()), ("text", pa.string())])))

    def _spans(text: str, rows: bool) -> list[dict]:
        places = [m.end() for m in marks[bool(rows)].finditer(text)]
        found, at = [], 0
        while at < len(text):
            last = bisect_right(places, at + sizes.pack)
            end = at + sizes.hard
            if end >= len(text):
                end = len(text)
            elif last and places[last - 1] > at:
                end = places[last - 1]
            elif last < len(places) and places[last] <= end:
                end = places[last]
            if text[at:end].strip():
                found.append({"since": at, "text": text[at:end]})
            at = end
        return found

    return spans.asNondeterministic()


def children(blocks: DataFrame, sizes: Sizes = Sizes(), exact: bool = False) -> DataFrame:
    """A row a child: document_id, section, child (from 0 in the section), child_id, parent_id, kind, path, page, begin, end and content.

    A section that is short and on one page is one child, heading included. Else its blocks are packed up to the target, not over pages, and a block beyond the hard limit is
    cut into children of its own: with exact, into spans of its text without a gap, else into pieces that may be joined anew."""
    s = sections(blocks).where(F.size("body") > 0)
    length = lambda x: F.length(x["text"])
    pages = F.array_distinct(F.filter(F.transform("body", lambda x: x["page"]), lambda p: p.isNotNull()))
    s = s.withColumn("single", (F.col("chars") <= sizes.pack) & (F.size(pages) <= 1))
    starts = packer(sizes.pack, 2)(F.transform("body", length), F.transform("body", lambda x: length(x) > sizes.hard), F.transform("body", lambda x: F.coalesce(x["page"], F.lit(-1))))
    s = s.withColumn("starts", starts)
    groups = F.when(F.col("single"), F.array("body")).otherwise(runs(F.col("body"), F.col("starts")))
    rows = s.select("document_id", "section", "path", F.col("page").alias("section_page"), F.col("begin").alias("section_begin"), F.col("end").alias("section_end"), "single", F.when(F.col("single"), _joined(F.col("b"))).alias("whole"), F.posexplode(groups).alias("g", "x"))
    first, last = F.get("x", F.lit(0)), F.get("x", F.size("x") - 1)
    kinds = F.array_distinct(F.transform("x", lambda x: x["kind"]))
    kind = F.element_at(F.create_map(*[F.lit(w) for pair in KINDS.items() for w in pair]), F.get(kinds, F.lit(0)))
    kind = F.when(F.size(kinds) > 1, "mixed").otherwise(F.coalesce(kind, F.get(kinds, F.lit(0))))
    long = ~F.col("single") & (F.size("x") == 1) & (length(first) > sizes.hard)
    rows = rows.select(
        "document_id", "section", "path", "g", F.when(long, first["kind"]).otherwise(kind).alias("kind"), F.coalesce(first["page"], "section_page").alias("page"), long.alias("long"),
        F.when(F.col("single"), F.col("section_begin")).otherwise(first["begin"]).alias("at"), F.when(F.col("single"), F.col("section_end")).otherwise(last["begin"] + length(last)).alias("until"),
        F.when(F.col("single"), F.col("whole")).otherwise(_joined(F.col("x"))).alias("text"),
    )
    if exact:
        spans = exact_spans(sizes)(F.when(F.col("long"), F.col("text")).otherwise(""), F.col("kind").isin("table", "code_block"))
        pieces = F.when(F.col("long"), spans).otherwise(F.array(F.struct(F.lit(0).alias("since"), F.col("text").alias("text"))))
        rows = rows.select("*", F.posexplode(pieces).alias("piece", "p")).withColumns({"since": F.col("p.since"), "content": F.col("p.text")}).repartition("document_id")
    else:
        long, table = F.col("long"), F.col("kind") == "table"
        own = lambda when: F.when(when, F.col("text")).otherwise("")
        rows = split(rows.withColumns({"prose": own(long & ~table), "rows": own(long & table)}), sizes, "prose", "rows", "of_prose", "of_rows")
        rows = rows.select("*", F.posexplode(F.when(long & table, F.col("of_rows")).when(long, F.col("of_prose")).otherwise(F.array("text"))).alias("piece", "content")).repartition("document_id")
        order = Window.partitionBy("document_id", "section", "g").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("since", F.coalesce(F.sum(F.length("content") + 2).over(order), F.lit(0)))
    begin = F.col("at") + F.col("since")
    child = F.row_number().over(Window.partitionBy("document_id", "section").orderBy("g", "piece")) - 1
    rows = rows.withColumns({"begin": begin, "end": F.when(F.col("long"), begin + F.length("content")).otherwise(F.col("until")), "child": child})
    return rows.select("document_id", "section", "child", F.concat_ws(":c:", parent_id(), F.col("child").cast("string")).alias("child_id"), parent_id().alias("parent_id"), "kind", "path", "page", "begin", "end", "content")


def semantic_tail(text: Column, most: Column) -> Column:
    """The last sentences of a text, joined by a space, that stay within most characters; the end of the last one where that alone is longer. The text's last 2 * most characters tell them, where
    the sentences there are longer than most together: only the first of these may have lost its beginning, and it did not fit."""
    start = F.struct(F.lit("").alias("t"), F.lit(False).alias("full"))

    def last(sentences: Column, m: Column) -> Column:
        def step(s: Column, x: Column) -> Column:
            alone, grown = s["t"] == "", F.length(s["t"]) + F.length(x) + 1
            add = lambda t, full: F.struct(t.alias("t"), F.lit(full).alias("full"))
            long = F.when(F.length(x) > m, add(stripped(F.right(x, m)), True)).otherwise(add(x, False))
            return F.when(s["full"], s).when(alone, long).when(grown > m, add(s["t"], True)).otherwise(add(F.concat_ws(" ", x, s["t"]), False))

        return F.aggregate(F.reverse(sentences), start, step)["t"]

    def of(m: Column) -> Column:
        near = lambda s: F.when((F.length(F.array_join(s, " ")) > m) | (F.length(text) <= m * 2), last(s, m)).otherwise(last(sentences(text), m))
        return F.when(m > 0, let(sentences(F.right(text, m * 2)), near)).otherwise("")

    return let(most, of)


def with_overlap(rows: DataFrame, sizes: Sizes = Sizes(), exempt: Column | None = None) -> DataFrame:
    """Children with the end of the child before them in their section in front of their content, as far as the hard limit leaves room: begin moves back by so many characters (not beyond
    the child before), core_begin and core_end keep the child's own place, and overlap is the number of characters carried over. Exempt children (rows of tables that come from
    sheets) carry none over."""
    order = Window.partitionBy("document_id", "section").orderBy("child")
    room = F.least(F.lit(sizes.overlap), F.greatest(F.lit(0), F.lit(sizes.most - 2) - F.length("content")))
    before = F.lag("content").over(order)
    rows = rows.withColumns({"before": before, "room": room, "from": F.lag("begin").over(order), "to": F.lag("end").over(order)})
    none = F.col("before").isNull() | (F.lit(False) if exempt is None else F.coalesce(exempt, F.lit(False)))
    rows = rows.withColumn("tail", F.when(none, "").otherwise(semantic_tail(F.col("before"), F.col("room"))))
    carried = F.col("tail") != ""
    changed = {
        "core_begin": F.col("begin"), "core_end": F.col("end"), "overlap": F.length("tail"),
        "begin": F.when(carried, F.greatest("from", F.col("to") - F.length("tail"))).otherwise(F.col("begin")),
        "content": F.when(carried, F.concat_ws("\n\n", "tail", "content")).otherwise(F.col("content")),
    }
    return rows.withColumns(changed).drop("before", "room", "from", "to", "tail")


# kinds of documents

#: Kinds that words tell, in the order in which equal scores are taken, and what a number of different words counts (fixed values).
WORDED, SIGNALS = ["legal", "contract", "paper", "meeting"], [(4, 0.9), (3, 0.75), (2, 0.6)]
#: Words of a kind (fixed values).
KEYWORDS = {
    "legal": ["人民法院", "法律规定", "行政法规", "司法解释", "诉讼请求", "裁判文书", "知识产权", "著作权", "专利权", "商标权"],
    "contract": ["甲方", "乙方", "违约责任", "保密义务", "不可抗力", "争议解决", "签字盖章", "合同期限", "本协议", "双方约定"],
    "paper": ["摘要", "关键词", "研究方法", "实验结果", "参考文献", "doi", "研究结论", "相关工作"],
    "meeting": ["会议纪要", "参会人员", "主持人", "记录人", "会议议程", "会议决议", "行动项", "待办事项"],
}


def document_profiles(blocks: DataFrame, titles: DataFrame, keywords: dict[str, list[str]] = KEYWORDS) -> DataFrame:
    """document_id, profile, score, margin and confidence. Blocks of code or tables count by their share; other kinds by how many of their words are in the title, the first 20 headings and
    the first 800 characters of the first 8 paragraphs. A best score below 0.6, or less than 0.1 above the next, is general. titles: document_id and title."""
    text = F.col("text")
    early = F.when(F.col("kind").isin("heading", "paragraph"), F.struct("place", "kind", F.lower(F.when(F.col("kind") == "paragraph", F.substring(text, 1, 800)).otherwise(text)).alias("text")))
    order = Window.partitionBy("document_id", "kind").orderBy("place")
    most = F.when(F.col("kind") == "heading", 20).otherwise(8)
    rows = blocks.where(stripped(text) != "").withColumn("early", F.when(F.row_number().over(order) <= most, early))
    d = rows.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "code_block").alias("code"), F.count_if(F.col("kind") == "table").alias("table"), F.array_join(F.transform(F.collect_list("early"), lambda x: x["text"]), "\n").alias("said"),
    ).join(titles.select("document_id", F.lower(F.coalesce("title", F.lit(""))).alias("title")), "document_id", "left")
    said = F.concat_ws("\n", "title", "said")
    share = lambda k: F.when((F.col(k) >= 1) & (F.col(k) * 2 >= F.col("n")), 0.9).when((F.col(k) >= 2) & (F.col(k) * 4 >= F.col("n")), 0.7).otherwise(0.0)

    def worded(kind: str) -> Column:
        found = sum((F.contains(F.col("all"), F.lit(w)).cast("int") for w in keywords[kind]), F.lit(0))
        return let(found, lambda n: F.when(n >= SIGNALS[0][0], SIGNALS[0][1]).when(n >= SIGNALS[1][0], SIGNALS[1][1]).when(n >= SIGNALS[2][0], SIGNALS[2][1]).otherwise(0.0))

    d = d.withColumn("all", said)
    names = ["general", *WORDED, "code", "table"]
    values = [F.lit(0.0), *map(worded, WORDED), share("code"), share("table")]
    ranked = F.reverse(F.array_sort(F.array(*[F.struct(v.alias("score"), F.lit(-k).alias("k"), F.lit(name).alias("name")) for k, (name, v) in enumerate(zip(names, values))])))
    d = d.withColumn("ranked", ranked).select("document_id", F.get("ranked", F.lit(0)).alias("best"), F.get("ranked", F.lit(1))["score"].alias("next"))
    margin = F.round(F.col("best.score") - F.col("next"), 6)
    sure = (F.col("best.score") >= 0.6) & (margin >= 0.1)
    confidence = F.round(F.when(sure, F.least(F.col("best.score"), F.lit(1.0))).otherwise(F.greatest(F.lit(0.5), 1 - F.col("best.score"))), 3)
    return d.select("document_id", F.when(sure, F.col("best.name")).otherwise("general").alias("profile"), F.col("best.score").alias("score"), margin.alias("margin"), confidence.alias("confidence"))


# windows over blocks


def _ordered_blocks(blocks: DataFrame) -> DataFrame:
    """A row a document: its non-blank blocks in order."""
    rows = blocks.where(stripped(F.col("text")) != "")
    return rows.groupBy("document_id").agg(_in_order(["kind", "level", "page", "text"], "place").alias("b"))


def window_numbers(blocks: DataFrame, chars: int = 6000, many: int = 32) -> DataFrame:
    """document_id, place, kind, level, page, text and window of every non-blank block. Another page, or a heading of the first level, always begins a window; so does a block that would make the
    window longer than chars (each block counts two more) or longer than many blocks, unless it or the block before it is a table, which keeps what explains it."""

    @F.pandas_udf("array<int>")
    def windows(sizes: pd.Series, heads: pd.Series, tables: pd.Series, pages: pd.Series) -> pd.Series:
        out = []
        for own in zip(sizes, heads, tables, pages):
            found: list[int] = []
            window, used, n, page, after_table = 0, 0, 0, -1, False
            for size, head, table, at in zip(*(x.tolist() for x in own)):
                over = used + size > chars or n >= many
                if n and (head or at != page or over and not (table or after_table)):
                    window, used, n = window + 1, 0, 0
                if not n:
                    page = at
                used, n, after_table = used + size + 2, n + 1, table
                found.append(window)
            out.append(found)
        return pd.Series(out)

    of = lambda f: F.transform("b", f)
    top = of(lambda x: (x["kind"] == "heading") & (F.coalesce(x["level"], F.lit(1)) <= 1))
    numbers = windows(of(lambda x: F.length(x["text"])), top, of(lambda x: x["kind"] == "table"), of(lambda x: F.coalesce(x["page"], F.lit(-1))))
    rows = _ordered_blocks(blocks).select("document_id", F.explode(F.arrays_zip(F.col("b").alias("b"), numbers.alias("window"))).alias("x"))
    return rows.select("document_id", "x.b.place", "x.b.kind", "x.b.level", "x.b.page", "x.b.text", "x.window")


def source_segments(blocks: DataFrame, chars: int = 6000, many: int = 32) -> DataFrame:
    """document_id, window, segment, place, start, stop and partial: all characters of all blocks, each once. A window has chars characters and many segments at most; a heading begins one; a block
    that does not fit is split."""

    @F.pandas_udf("array<struct<window:int,segment:int,k:int,start:int,stop:int>>")
    def segments(sizes: pd.Series, heads: pd.Series) -> pd.Series:
        out = []
        for own in zip(sizes, heads):
            found: list[dict] = []
            window, used, n = 0, 0, 0
            for k, (size, head) in enumerate(zip(*(x.tolist() for x in own))):
                if head and n:
                    window, used, n = window + 1, 0, 0
                start = 0
                while start < size:
                    if used == chars or n == many:
                        window, used, n = window + 1, 0, 0
                    stop = min(size, start + chars - used)
                    found.append({"window": window, "segment": n, "k": k, "start": start, "stop": stop})
                    used, n, start = used + stop - start, n + 1, stop
            out.append(found)
        return pd.Series(out)

    of = lambda f: F.transform("b", f)
    cut = segments(of(lambda x: F.length(x["text"])), of(lambda x: x["kind"] == "heading"))
    rows = _ordered_blocks(blocks).select("document_id", "b", F.explode(cut).alias("s"))
    own = F.get("b", F.col("s.k"))
    partial = (F.col("s.start") > 0) | (F.col("s.stop") < F.length(own["text"]))
    return rows.select("document_id", "s.window", "s.segment", own["place"].alias("place"), "s.start", "s.stop", partial.alias("partial"))


def judged_groups(windows: DataFrame, ends: DataFrame, chars: int = 6000) -> DataFrame:
    """document_id, window and verdict (valid, or the first thing wrong) of proposed groups. windows: rows of ``window_numbers``; ends: document_id, window and ends, an
    array of places in the window (from 0), each the last block of a group. Ends must rise, stay in the window and reach its last block; a group has chars characters at most
    (each block two more); none may end next to a table or on a heading, but at the window's end."""
    w = windows.withColumn("n", F.length("text")).groupBy("document_id", "window").agg(_in_order(["kind", "n"], "place").alias("b"))
    rows = w.join(ends, ["document_id", "window"])
    n = F.size("b")
    kind = lambda i: F.get("b", i)["kind"]
    pairs = F.transform("ends", lambda e, i: F.struct(F.when(i > 0, F.get("ends", i - 1)).otherwise(-1).alias("before"), e.alias("end")))
    size = lambda p: F.aggregate(F.slice("b", p["before"] + 2, F.greatest(p["end"] - p["before"], F.lit(0))), F.lit(0), lambda s, x: s + x["n"] + 2)
    fits = lambda p: F.coalesce((p["before"] < p["end"]) & (p["end"] < n), F.lit(False))
    wrong = lambda p: (
        F.when(~fits(p), "invalid_boundary").when(size(p) > chars, "oversize_group")
        .when((p["end"] < n - 1) & ((kind(p["end"]) == "table") | (kind(p["end"] + 1) == "table")), "table_context_split").when((p["end"] < n - 1) & (kind(p["end"]) == "heading"), "heading_context_split")
    )
    first = F.get(F.array_compact(F.transform(pairs, wrong)), F.lit(0))
    counted = F.coalesce(F.size("ends").between(1, n), F.lit(False))
    verdict = F.when(~counted, "invalid_count").otherwise(F.coalesce(first, F.when(F.get("ends", F.size("ends") - 1) != n - 1, "incomplete_coverage").otherwise("valid")))
    return rows.select("document_id", "window", n.alias("n"), verdict.alias("verdict"))


def window_risks(windows: DataFrame, hard: int = 900, chars: int = 6000, many: int = 32) -> DataFrame:
    """document_id, window, first and last place, n, score, excluded and eligible of each window: fragments 3, a table with an explanation 4, long paragraphs without a heading 2; windows of one
    block, with code, or beyond the limits are excluded."""
    is_ = lambda k: F.col("kind") == k
    n = F.length("text")
    w = windows.groupBy("document_id", "window").agg(
        F.min("place").alias("first"), F.max("place").alias("last"), F.count(F.lit(1)).alias("n"), F.count_if(is_("paragraph")).alias("paragraphs"),
        F.count_if(is_("paragraph") & (F.length(stripped(F.col("text"))) < 100)).alias("short"), F.count_if(is_("table")).alias("tables"), F.count_if(is_("heading")).alias("headings"),
        F.count_if(is_("code_block")).alias("code"), F.count_if(is_("paragraph") & (n > hard)).alias("long"), F.sum(n + 2).alias("size"), F.max(n).alias("longest"),
    )
    p = F.col("paragraphs")
    fragments = (p >= 4) & (F.col("short") * 10 >= p * 6)
    explained = (p > 0) & (F.col("tables") > 0)
    unstructured = (p >= 2) & (F.col("headings") == 0) & (F.col("long") > 0)
    score = F.when(fragments, 3).otherwise(0) + F.when(explained, 4).otherwise(0) + F.when(unstructured, 2).otherwise(0)
    excluded = (F.col("n") < 2) | (F.col("code") > 0) | (F.col("n") > many) | (F.col("size") > chars) | (F.col("longest") > chars)
    return w.select("document_id", "window", "first", "last", "n", score.alias("score"), excluded.alias("excluded"), ((score > 0) & ~excluded).alias("eligible"))


# candidates


def tally(children: str, short_children: str, short: int = 100) -> list[Column]:
    return [F.count(F.lit(1)).alias(children), F.count_if(F.length("content") < short).alias(short_children)]


def tallies(rows: DataFrame, short: int = 100) -> DataFrame:
    """document_id, children and short_children."""
    return rows.groupBy("document_id").agg(*tally("children", "short_children", short))


def chosen_windows(risks: DataFrame, most: int = 2) -> DataFrame:
    """The eligible windows of each document with the highest scores, the earlier of equal ones."""
    order = Window.partitionBy("document_id").orderBy(F.desc("score"), "window")
    return risks.where("eligible").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def regrouped(windows: DataFrame, groups: DataFrame) -> DataFrame:
    """Blocks with the number of the group they belong to: groups (document_id, window, ends), which are valid, cut their windows; the blocks before, between and after
    such windows are groups of their own. Documents without a group are left out."""
    order = Window.partitionBy("document_id").orderBy("place")
    inside = F.row_number().over(Window.partitionBy("document_id", "window").orderBy("place")) - 1
    rows = windows.withColumn("k", inside).join(groups.select("document_id", "window", "ends"), ["document_id", "window"], "left")
    rows = rows.join(groups.select("document_id").distinct(), "document_id", "left_semi")
    cut = F.col("ends").isNotNull()
    begins = F.when(cut, (F.col("k") == 0) | F.array_contains("ends", F.col("k") - 1)).otherwise(F.lag(cut, 1, True).over(order))
    return rows.withColumn("begins", begins).withColumn("group", F.count_if("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("k", "begins", "ends")


def children_of_groups(rows: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """Children, with what they carry over, of ``regrouped`` blocks, each group split as if it were a document; places are those in the document."""
    order = Window.partitionBy("document_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("offset", F.coalesce(F.sum(F.length(stripped(F.col("text"))) + 2).over(order), F.lit(0)))
    offsets = rows.groupBy(F.struct("document_id", "group").alias("document_id")).agg(F.min("offset").alias("offset"))
    own = _grouped_children(rows, sizes).join(offsets, "document_id")
    places = [(F.col(c) + F.col("offset")).alias(c) for c in ("begin", "end", "core_begin", "core_end")]
    return own.select("document_id.document_id", "document_id.group", "section", "child", "kind", "path", "page", *places, "overlap", "content")


def _grouped_children(rows: DataFrame, sizes: Sizes) -> DataFrame:
    """Children of ``regrouped`` blocks whose document_id is a struct of document_id and group; places are those in the group."""
    return with_overlap(children(rows.withColumn("document_id", F.struct("document_id", "group")), sizes), sizes)


def adaptive_candidate(blocks: DataFrame, windows: DataFrame, proposals: DataFrame, most: int = 2, sizes: Sizes = Sizes()) -> DataFrame:
    """A row a document: windows tried and accepted, children and short ones before (base) and after (made), and the decision. The windows of the highest risk are cut as proposed
    (document_id, window, ends) where that is valid; the rest keeps its boundaries. A candidate with more children and two short ones more is refused. The windows are read several times, so
    they should be a written table; the few that are chosen are written here."""
    risks = window_risks(windows, sizes.most)
    chosen = chosen_windows(risks, most).join(proposals, ["document_id", "window"])
    chosen = chosen.join(judged_groups(windows, proposals).select("document_id", "window", "verdict"), ["document_id", "window"]).select("document_id", "window", "ends", "verdict")
    chosen = store.written(chosen, "chosen")
    made = tallies(_grouped_children(regrouped(windows, chosen.where("verdict = 'valid'")), sizes).select("document_id.document_id", "content"))
    base = tallies(with_overlap(children(blocks, sizes), sizes)).withColumnsRenamed({"children": "base", "short_children": "base_short"})
    tried = chosen.groupBy("document_id").agg(F.count(F.lit(1)).alias("windows"), F.count_if(F.col("verdict") == "valid").alias("accepted"))
    seen = risks.groupBy("document_id").agg(F.bool_or("excluded").alias("limited"))
    rows = base.join(seen, "document_id").join(tried, "document_id", "left").join(made.withColumnsRenamed({"children": "made", "short_children": "made_short"}), "document_id", "left")
    decision = (
        F.when(F.col("windows").isNull(), F.when(F.col("limited"), "rules_limited").otherwise("no_risk")).when(F.col("accepted") == 0, "model_fallback")
        .when((F.col("made") > F.col("base")) & (F.col("made_short") >= F.col("base_short") + 2), "quality_fallback").otherwise("applied")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return rows.select("document_id", zero("windows"), zero("accepted"), "base", "base_short", "made", "made_short", decision.alias("decision"))


def repaired_headings(blocks: DataFrame) -> DataFrame:
    """Blocks in which false headings are paragraphs: a heading of capitals alone that has a digit, or two Latin letters at most, is one unless it is numbered. A
    numbered heading has the level that its number says."""
    heading = F.col("kind") == "heading"
    text = F.when(heading, F.col("text"))  # the patterns are for headings, and null elsewhere
    numbered = F.when(text.rlike(r"^\s*\d+(\.\d+)+[.\s]"), F.size(F.split(F.regexp_extract(text, r"^\s*([\d.]*\d)", 1), r"\."))).when(text.rlike(r"^\s*(第[一二三四五六七八九十百\d]+章|\d+[.、]\s*\S)"), 1)
    capitals = text.rlike(r"\p{Lu}") & ~text.rlike(r"\p{Ll}")
    false = capitals & (text.rlike(r"\p{Nd}") | (F.length(F.regexp_replace(text, "[^A-Z]", "")) <= 2)) & numbered.isNull()
    demoted = heading & F.coalesce(false, F.lit(False))
    return blocks.withColumns({"kind": F.when(demoted, "paragraph").otherwise(F.col("kind")), "level": F.when(heading & ~demoted, F.coalesce(numbered, F.col("level"), F.lit(1)))})


def source_texts(blocks: DataFrame) -> DataFrame:
    """document_id and text: what all places of a document's sections and children are in."""
    rows = blocks.select("document_id", "place", stripped(F.col("text")).alias("text")).where("text <> ''")
    return rows.groupBy("document_id").agg(_joined(_in_order(["text"], "place")).alias("text"))


def coverage(spans: DataFrame, sources: DataFrame) -> DataFrame:
    """A row a document: chars that are not white space, those that no span holds (missing), those that two hold (twice), and spans that do not say what the source says at their
    place (unverified; they hold nothing). spans: document_id, begin and content."""
    own = spans.groupBy("document_id").agg(F.collect_list(_span("begin", "content")).alias("s"))
    return _covered(sources.join(own, "document_id", "left"))


def _span(begin: str, content: str) -> Column:
    return F.struct(F.col(begin).cast("long").alias("begin"), F.col(content).alias("content"))


def _covered(rows: DataFrame, *more: str, twice: bool = True) -> DataFrame:
    """``coverage`` of rows with document_id, text and s, all spans (begin, content) of the document, or null; more columns are kept, and twice is left out where it isn't asked for. The text is held in parts of PART characters, so that what stands at a place is
    found without going through all that is before it."""
    rows = rows.select("document_id", "text", *more, F.array_sort(F.coalesce("s", F.array().cast("array<struct<begin:bigint,content:string>>"))).alias("s"), hard_pieces(F.col("text"), PART).alias("parts"))

    def at(begin: Column, n: Column) -> Column:
        begin, n = begin.cast("int"), n.cast("int")
        first, last = F.floor(begin / PART).cast("int"), F.floor((begin + n - 1) / PART).cast("int")
        found = F.array_join(F.transform(F.sequence(first, last), lambda k: F.get("parts", k)), "")
        return F.when((begin < 0) | (n < 1), "").otherwise(F.substring(found, begin - first * PART + 1, n))

    solid = lambda text: F.length(F.regexp_replace(text, r"(?U)\s", "")).cast("long")
    said = F.filter("s", lambda x: at(x["begin"], F.length(x["content"])) == x["content"])
    rows = rows.select("document_id", "text", "parts", *more, F.size("s").alias("n"), said.alias("s"))
    counts = ["reached", "missing", *(["twice"] if twice else [])]

    def step(a: Column, x: Column) -> Column:
        begin, end = x["begin"], x["begin"] + F.length(x["content"])
        gap = F.when(begin > a["reached"], solid(at(a["reached"], begin - a["reached"]))).otherwise(0)
        again = F.when(begin < a["reached"], solid(at(begin, F.least(end, a["reached"]) - begin))).otherwise(0)
        return F.struct(F.greatest(a["reached"], end).alias("reached"), (a["missing"] + gap).alias("missing"), *([(a["twice"] + again).alias("twice")] if twice else []))

    whole = F.length("text").cast("long")
    held = rows.select("document_id", "text", "parts", *more, "n", F.size("s").alias("verified"), F.aggregate("s", F.struct(*[F.lit(0).cast("long").alias(c) for c in counts]), step).alias("a"))
    rest = F.when(F.col("a.reached") < whole, solid(at(F.col("a.reached"), whole - F.col("a.reached")))).otherwise(0)
    found = [solid(F.col("text")).alias("chars"), (F.col("a.missing") + rest).alias("missing"), *([F.col("a.twice").alias("twice")] if twice else [])]
    return held.select("document_id", *more, *found, (F.col("n") - F.col("verified")).cast("long").alias("unverified"))


def structural_candidate(blocks: DataFrame, serving: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """A row a document: children and short ones that serve now (serving: document_id and content) and of a candidate made of repaired headings and exact spans; what of the source its
    parents (but shortened ones) and children do not hold; and whether it is more fragmented: more children, and a greater share of short ones."""
    repaired = repaired_headings(blocks)
    own = with_overlap(children(repaired, sizes, exact=True).withColumn("exact", F.col("content")), sizes)
    made = own.groupBy("document_id").agg(*tally("made", "made_short"), F.collect_list(_span("core_begin", "exact")).alias("own"))
    held = parents(repaired).where("not truncated").groupBy("document_id").agg(F.collect_list(_span("begin", "content")).alias("held"))
    rows = source_texts(blocks).join(made, "document_id").join(held, "document_id", "left").withColumn("s", F.concat("own", F.coalesce("held", F.array().cast("array<struct<begin:bigint,content:string>>"))))
    proof = _covered(rows, "made", "made_short", twice=False).select("document_id", "made", "made_short", "missing", "unverified")
    rows = tallies(serving).join(proof, "document_id")
    more = (F.col("made") > F.col("children")) & (F.col("made_short") > F.col("short_children")) & (F.col("made_short") * F.col("children") > F.col("short_children") * F.col("made"))
    return rows.select("document_id", "children", "short_children", "made", "made_short", "missing", "unverified", more.alias("regressed"))
