"""Chat formatting into budgeted windows, with a loss mask.

A turn is written as ``<|turn|>role<|text|>text<|end|>``. Inside roles and texts a backslash is doubled, and one is put
after the first character of every control string (those of this template and of common others), so no text can end or
begin a turn, and taking one backslash of each pair away gives the text back.

Prefix sums of the turns' tokens choose turn-aligned windows: the sums are cut into strides of the budget less the system
turn and the history; turns that lie within one stride share a window, and a turn that crosses a border has its own. So a
window is within the budget unless a single turn is not. A conversation's first turn, if it is a system turn, opens each
of its windows. Turns before the window, as many whole ones as fit into the history budget, are repeated in front of
it. The loss mask has the text of each assistant turn in the one window where it is not repeated.

Cases: null texts and roles are empty, a null conv_id is a conversation of its own. Rows of one conversation with equal
turn numbers are ordered by role, then text; repeated rows are turns each. An empty table gives no windows. Other
columns are not read. ``windows`` deals the turns of a long conversation to many tasks by ranges of their order. ``read_back`` has one value
per conversation, for the digests are of all its turns in order; that ends at Spark's 2 GB for a value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.store import written

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Where a control string begins: its first character, before the rest.
CONTROL = r"([<\[])(?=\||/?INST\]|/?s>|</?SYS>>)"
#: What counts as a token: at most six word characters, or one other character (a letter beyond ASCII is one too).
TOKEN = r"\w{1,6}|[^\w\s]"
#: Characters of a conversation beyond which its turns are dealt to many tasks.
LONG = 8_000_000
#: Conversations whose ids are broadcast at most.
MAX_BROADCAST = 1_000_000


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _turns(conversations: DataFrame) -> DataFrame:
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = _with_template(conversations.select("conv_id", "turn", role.alias("role"), text.alias("text")))
    return rows.withColumn("tokens", F.regexp_count("turn_text", F.lit(TOKEN)).cast("long"))


def _with_template(rows: DataFrame) -> DataFrame:
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT))
    return rows.withColumns({"head": head, "body": escape(F.col("text"))}).withColumn("turn_text", F.concat("head", "body", F.lit(END)))


def _window(opening_tokens: Column, budget: int, history: int) -> Column:
    """The window of a turn by its start and tokens: that of its stride, or its own where it crosses a border."""
    stride = F.greatest(F.lit(1), F.lit(budget - history) - F.coalesce(opening_tokens, F.lit(0)))
    at, last = F.floor(F.col("start") / stride), F.floor((F.col("start") + F.col("tokens") - 1) / stride)
    return at * 2 + (at != last).cast("long")


def _with_loss(rows: DataFrame) -> DataFrame:
    """Adds n, the place in the window, and loss, the text of an assistant turn in the turns of its window."""
    inside = Window.partitionBy("conv_id", "window").orderBy("pos")
    rows = rows.withColumns({"n": F.row_number().over(inside), "offset": F.sum(F.length("turn_text")).over(inside) - F.length("turn_text")})
    return rows.withColumn("loss", F.when(F.col("role") == "assistant", F.struct((F.col("offset") + F.length("head")).alias("begin"), F.length("body").alias("length"))))


PLACED = ("conv_id", "window", "pos", "turn_text", "loss", "repeated")


def _by_conversation(turns: DataFrame, budget: int, history: int) -> DataFrame:
    """The turns in their windows, each conversation in one task; repeated is not empty for the first turn of a window at most."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.withColumn("pos", F.row_number().over(order)).withColumn("system", (F.col("pos") == 1) & (F.col("role") == "system"))
    by_pos = Window.partitionBy("conv_id").orderBy("pos")
    whole = by_pos.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("opening", F.first(F.when(F.col("system"), F.struct("turn_text", "tokens"))).over(whole))
    own = F.when(F.col("system"), 0).otherwise(F.col("tokens"))
    rows = rows.withColumn("start", F.coalesce(F.sum(own).over(by_pos.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("window", _window(F.col("opening.tokens"), budget, history))
    rows = rows.withColumn("window", F.when(F.col("system"), F.coalesce(F.lead("window").over(by_pos), F.lit(0))).otherwise(F.col("window")))
    # what may be repeated before a turn: the turns whose tokens begin in the history budget before it
    near = Window.partitionBy("conv_id").orderBy("start").rangeBetween(-history, -1)
    rows = _with_loss(rows.withColumn("near", F.collect_list(F.when(~F.col("system"), F.col("turn_text"))).over(near)))
    opened = F.when((F.col("n") == 1) & (F.col("pos") > 1), F.array_compact(F.concat(F.array("opening.turn_text"), F.col("near"))))
    return rows.withColumn("repeated", F.coalesce(opened, F.array().cast("array<string>"))).select(*PLACED)


def _by_ranges(turns: DataFrame, budget: int, history: int) -> DataFrame:
    """The same for conversations too long for one task. Turns are dealt by ranges of their order and written; a range
    goes on with the sums of those before, which only its first conversation can have, so one row per range is broadcast. A
    window's history is joined by pieces of the history's length. Of turns equal in number, role and the text's begin, all are in one range."""
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    borders = ("conv_id", "turn", "role", F.substring("text", 1, 64))
    bare = turns.select("conv_id", "turn", "role", "text", "tokens")
    dealt = written(bare.repartitionByRange(parts, *borders).withColumn("range", F.spark_partition_id()), "turns")
    sums = dealt.groupBy("conv_id", "range").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("sum"))
    earlier = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range and conversation
    sums = sums.select("conv_id", "range", F.sum("n").over(earlier).alias("n_before"), F.sum("sum").over(earlier).alias("sum_before")).where("n_before is not null")
    inside = Window.partitionBy("range", "conv_id").orderBy("turn", "role", "text")
    until = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = _with_template(dealt).withColumns({"pos": F.row_number().over(inside), "start": F.sum("tokens").over(until) - F.col("tokens")})
    rows = _same(rows, F.broadcast(sums), ["conv_id", "range"], "left")
    rows = rows.withColumns({"pos": F.col("pos") + F.coalesce("n_before", F.lit(0)), "start": F.col("start") + F.coalesce("sum_before", F.lit(0))})
    rows = rows.withColumn("system", (F.col("pos") == 1) & (F.col("role") == "system"))
    at = lambda c, when: F.max(F.when(when, F.col(c)))
    heads = rows.where("pos <= 2").groupBy("conv_id").agg(at("tokens", F.col("system")).alias("opening_tokens"), at("tokens", F.col("pos") == 2).alias("second"), at("turn_text", F.col("system")).alias("opening"))
    heads = written(heads, "openings")  # a row per long conversation
    rows = _same(rows, _few(heads.drop("opening")), ["conv_id"], "left")
    # the system turn counts in no sum and is in the window of the turn after it
    start = F.when(F.col("system"), 0).otherwise(F.col("start") - F.coalesce("opening_tokens", F.lit(0)))
    rows = rows.withColumns({"start": start, "tokens": F.when(F.col("system"), F.coalesce("second", F.lit(1))).otherwise(F.col("tokens"))})
    rows = rows.withColumn("window", _window(F.col("opening_tokens"), budget, history))
    rows = written(_with_loss(rows).select("conv_id", "window", "pos", "n", "start", "system", "turn_text", "loss"), "placed")
    piece = lambda c: F.floor(c / max(history, 1))
    firsts = rows.where("n = 1 and pos > 1").select("conv_id", F.col("pos").alias("first"), F.col("start").alias("begin"))
    asked = firsts.withColumn("piece", F.explode(F.sequence(piece(F.col("begin") - history), piece(F.col("begin") - 1))))
    near = _same(rows.where("not system").withColumn("piece", piece(F.col("start"))), asked, ["conv_id", "piece"], "inner")
    near = near.where((F.col("start") >= F.col("begin") - history) & (F.col("start") < F.col("begin")))
    near = near.groupBy("conv_id", "first").agg(F.array_sort(F.collect_list(F.struct("pos", "turn_text")))["turn_text"].alias("near"))
    opened = _same(_same(firsts, near, ["conv_id", "first"], "left"), heads.select("conv_id", "opening").where("opening is not null"), ["conv_id"], "left")
    nothing = F.array().cast("array<string>")
    opened = opened.select("conv_id", F.col("first").alias("pos"), F.array_compact(F.concat(F.array("opening"), F.coalesce("near", nothing))).alias("repeated"))
    return _same(rows, opened, ["conv_id", "pos"], "left").withColumn("repeated", F.coalesce("repeated", nothing)).select(*PLACED)


def _same(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A join on keys where null equals null; the columns of both, the keys once."""
    right = right.withColumnsRenamed({k: "same_" + k for k in keys})
    return left.join(right, [F.col(k).eqNullSafe(F.col("same_" + k)) for k in keys], how).drop(*["same_" + k for k in keys])


def _few(rows: DataFrame) -> DataFrame:
    """rows (of ``written``), broadcast where they are counted to be few."""
    return F.broadcast(rows) if rows.count() <= MAX_BROADCAST else rows


def windows(conversations: DataFrame, budget: int = 1024, history: int = 256, long: int = LONG) -> DataFrame:
    """One row per window: conv_id, window, n_repeated (leading turns that another window has too), formatted, and loss, an
    array of begin and length in characters of formatted. A conversation of more than long characters is not put into one task."""
    size = F.coalesce(F.length("text"), F.lit(0)) + F.coalesce(F.length("role"), F.lit(0)) + len(TURN + TEXT + END)
    large = conversations.groupBy("conv_id").agg(F.sum(size.cast("long")).alias("size")).where(F.col("size") > long)
    large = written(large.select("conv_id"), "long-conversations")
    turns = _turns(conversations)
    if large.isEmpty():
        rows = _by_conversation(turns, budget, history)
    else:
        few = _few(large)
        rows = _by_conversation(_same(turns, few, ["conv_id"], "left_anti"), budget, history).unionByName(_by_ranges(_same(turns, few, ["conv_id"], "left_semi"), budget, history))
    rows = rows.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list(F.struct("pos", "turn_text", "loss"))).alias("turns"), F.flatten(F.collect_list(F.when(F.size("repeated") > 0, F.col("repeated")))).alias("repeated"))
    lead = F.array_join("repeated", "")
    loss = F.transform(F.filter("turns", lambda t: t["loss"].isNotNull()), lambda t: F.struct((F.length(lead) + t["loss"]["begin"]).alias("begin"), t["loss"]["length"].alias("length")))
    return rows.select("conv_id", "window", F.size("repeated").alias("n_repeated"), F.concat(lead, F.array_join("turns.turn_text", "")).alias("formatted"), loss.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """From windows alone, per conversation: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    parts = F.split("formatted", r"<\|end\|>")
    new = F.slice(parts, F.col("n_repeated") + 1, F.size(parts) - 1 - F.col("n_repeated"))
    fields = lambda t: F.split(F.substring(t, len(TURN) + 1, 1 << 30), r"<\|text\|>", 2)
    turns = F.transform(new, lambda t: F.concat(unescape(fields(t)[0]), F.lit("\n"), unescape(fields(t)[1]), F.lit("\n")))
    loss = F.transform("loss", lambda x: unescape(F.substring(F.col("formatted"), x["begin"].cast("int") + 1, x["length"])))
    rows = formatted.select("conv_id", "window", F.size(new).alias("n"), F.array_join(turns, "").alias("turns"), F.array_join(loss, "").alias("loss"), F.length("formatted").alias("chars"))
    rows = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", "turns", "loss"))).alias("all"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    turns, loss = F.array_join("all.turns", ""), F.array_join("all.loss", "")
    digest = lambda x: F.sha2(x.cast("binary"), 256)
    return rows.select("conv_id", "n_turns", digest(turns).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), digest(loss).alias("loss_sha256"), "formatted_chars")
