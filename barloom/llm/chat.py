"""Conversations as training windows of a bounded number of tokens.

Prefix sums of the turns' tokens place every turn on its conversation's line of
tokens.  The line is cut into areas of ``AREA`` spans; within an area a span takes
turns as long as they fit, so spans hold whole turns.  A window is a span, with
the conversation's system turn and the last turns before the span, up to
``history`` tokens, repeated in front of it.  The loss mask covers the texts of
assistant turns in the span alone: what is repeated is context.

    <|im_start|>role
    text<|im_end|>

Inside roles and texts each ``<|`` gets a backslash (``<\\|``; those that have some get
one more), so marks appear where the template puts them alone, and reading back
takes one away.  Only DataFrame functions are used.  No step gathers a
conversation: sums are taken per sorted partition first, and history meets spans
in buckets of the line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import written

BEGIN, END = "<|im_start|>", "<|im_end|>\n"
#: Tokens of a turn's marks.
MARKS = 4
#: Spans in an area.
AREA = 16
SPAN = "array<struct<start: bigint, stop: bigint>>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escaped_role(role: Column) -> Column:
    """A role on one line: backslashes and line ends are written as two letters."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n")))


def unescaped_role(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


def turn_tokens(role: Column, text: Column) -> Column:
    """An upper estimate: a token for every four bytes begun, and the marks."""
    return F.ceil((F.octet_length(role) + F.octet_length(text)) / 4).cast("long") + MARKS


def _joined(a: DataFrame, b: DataFrame, also: str) -> DataFrame:
    """Inner join on equal conv_id (nulls too) and another column."""
    b = b.withColumnRenamed("conv_id", "__conv").withColumnRenamed(also, "__also")
    return a.join(b, F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col(also) == F.col("__also"))).drop("__conv", "__also")


def _placed(turns: DataFrame) -> DataFrame:
    """The turns in order, each with its place (``spot``) among all turns."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")
    )
    rows = rows.withColumn("h", F.xxhash64("role", "text")).withColumn("tie", F.monotonically_increasing_id())
    order = ["conv_id", "turn", "h", "tie"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("spot", F.monotonically_increasing_id())
    return rows.select(
        "conv_id", "spot", "role", turn_tokens(F.col("role"), F.col("text")).alias("tokens"),
        F.concat(F.lit(BEGIN), escaped_role(F.col("role")), F.lit("\n")).alias("head"), escaped(F.col("text")).alias("body"),
    )


def _lines(placed: DataFrame, budget: int, history: int) -> DataFrame:
    """Each turn on its conversation's line: the tokens ``before`` it, the conversation's
    ``total``, its system turn (``sys``: spot, before, tokens) and the ``step`` that a span may take."""
    small = placed.select("conv_id", "spot", "tokens", (F.col("role") == "system").alias("is_sys"), F.shiftright("spot", 33).alias("part"))
    order = Window.partitionBy("conv_id", "part").orderBy("spot")
    small = small.withColumn("near", F.sum("tokens").over(order) - F.col("tokens"))
    # a row for each conversation and partition of the sort
    parts = small.groupBy("conv_id", "part").agg(
        F.sum("tokens").alias("sum"), F.min(F.when(F.col("is_sys"), F.struct("spot", "tokens"))).alias("sys")
    )
    conv = Window.partitionBy("conv_id")
    parts = parts.withColumn("far", F.sum("sum").over(conv.orderBy("part")) - F.col("sum"))
    parts = parts.withColumn("total", F.sum("sum").over(conv)).withColumn("sys", F.min("sys").over(conv)).drop("sum")
    rows = _joined(small, parts, "part").select("conv_id", "spot", "tokens", (F.col("near") + F.col("far")).alias("before"), "total", "sys")
    step = F.greatest(F.lit(budget - history) - F.coalesce("sys.tokens", F.lit(0)), F.lit(budget // 4)).cast("long")
    return rows.withColumn("step", step)


def _spans(lines: DataFrame) -> DataFrame:
    """Each turn with its span: the tokens before it (``start``) and its first turn (``first``)."""
    lines = lines.withColumn("area", F.floor(F.col("before") / (AREA * F.col("step"))))
    areas = lines.groupBy("conv_id", "area").agg(
        F.sort_array(F.collect_list(F.struct("before", "spot", "tokens"))).alias("turns"), F.first("step").alias("step"), F.first("sys").alias("sys"), F.first("total").alias("total"),
    )
    none = F.struct(F.lit(-1).cast("long").alias("base"), F.array().cast("array<struct<start: bigint, first: bigint>>").alias("cuts"))

    def take(state: Column, turn: Column) -> Column:
        full = (state["base"] < 0) | (turn["before"] + turn["tokens"] - state["base"] > F.col("step"))
        cut = F.array(F.struct(turn["before"].alias("start"), turn["spot"].alias("first")))
        return F.when(full, F.struct(turn["before"].alias("base"), F.concat(state["cuts"], cut).alias("cuts"))).otherwise(state)

    areas = areas.withColumn("cuts", F.aggregate("turns", none, take, lambda state: state["cuts"]))
    own = lambda t: F.element_at(F.filter("cuts", lambda c: c["start"] <= t["before"]), -1)
    each = F.transform(
        "turns", lambda t: F.struct(t["spot"].alias("spot"), t["tokens"].alias("tokens"), t["before"].alias("before"), own(t).alias("cut"))
    )
    rows = areas.select("conv_id", "area", "step", "sys", "total", F.explode(each).alias("t"))
    return rows.select("conv_id", "area", "step", "sys", "total", "t.spot", "t.tokens", "t.before", "t.cut.start", "t.cut.first")


def _wanted(spans: DataFrame, history: int) -> DataFrame:
    """``conv_id, start, first, spot, salt``: each window's turns, its own and the repeated ones."""
    own = spans.select("conv_id", "start", "first", "spot", F.lit(0).cast("long").alias("salt"))
    several = spans.where((F.col("total") > F.col("step")) | (F.col("area") > 0))
    starts = several.where("spot = first").select("conv_id", "start", "first", "sys", "area")
    system = starts.where("first > sys.spot").select("conv_id", "start", "first", F.col("sys.spot").alias("spot"), F.col("area").alias("salt"))
    if history < 1:
        return own.unionByName(system)
    # a turn may be history of spans that start in (before, before + history]: two buckets at most
    floor = lambda x: F.floor(x / history)
    past = several.where(F.col("sys").isNull() | (F.col("spot") != F.col("sys.spot"))).select("conv_id", "spot", "before")
    past = past.withColumn("bucket", F.explode(F.sequence(floor(F.col("before") + 1), floor(F.col("before") + history))))
    starts = starts.withColumn("bucket", floor(F.col("start"))).drop("sys", "area")
    met = _joined(starts, past, "bucket").where((F.col("before") < F.col("start")) & (F.col("before") + history >= F.col("start")))
    return own.unionByName(system).unionByName(met.select("conv_id", "start", "first", "spot", F.lit(0).cast("long").alias("salt")))


def chat_windows(turns: DataFrame, budget: int = 2048, history: int = 256) -> DataFrame:
    """``conv_id, turn, role, text`` -> a row for each window: ``conv_id, start, text, loss,
    n_repeated, n_turns, n_tokens``.

    ``start`` is the number of the conversation's tokens before the window's span;
    ``loss`` the stretches (start, stop) of ``text``, in code points, that count; the first
    ``n_repeated`` turns repeat earlier ones.  ``n_tokens`` is at most ``budget``, but where
    a single turn is longer than a span may be, or the system turn takes over three
    quarters: such turns stay whole.

    Turns go by ``turn`` (nulls first), equal ones by a hash of role and text; repeated
    rows are turns each.  The system turn is the first one with that role; windows
    that begin after it repeat it.  A null text or role is empty.  Rows with a null
    conv_id are one conversation.  Other columns are left out; an empty table gives
    no rows.
    """
    placed = written(_placed(turns), "turns")
    spans = written(_spans(_lines(placed, budget, history)), "spans")
    wanted = _wanted(spans, history)
    texts = placed.select("spot", (F.col("role") == "assistant").alias("talks"), "head", "body", "tokens")
    # the system turn of a long conversation, once for each area that repeats it
    copies = spans.where("area > 0 and spot = first and first > sys.spot").select(
        F.col("sys.spot").alias("spot"), F.col("area").alias("salt")
    ).distinct()
    texts = texts.withColumn("salt", F.lit(0).cast("long")).unionByName(texts.join(copies, "spot"))
    rows = wanted.join(texts, ["spot", "salt"])
    turn = F.struct("spot", (F.col("spot") < F.col("first")).alias("again"), "talks", "head", "body", "tokens")
    rows = rows.groupBy("conv_id", "start").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    size = lambda *parts: sum((F.length(p).cast("long") for p in parts), F.lit(0).cast("long"))
    none = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPAN).alias("loss"))

    def masked(state: Column, t: Column) -> Column:
        begin = state["at"] + size(t["head"])
        span = F.array(F.struct(begin.alias("start"), (begin + size(t["body"])).alias("stop")))
        loss = F.when(t["talks"] & ~t["again"], F.concat(state["loss"], span)).otherwise(state["loss"])
        return F.struct((begin + size(t["body"]) + len(END)).alias("at"), loss.alias("loss"))

    text = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    return rows.select(
        "conv_id", "start", text.alias("text"), F.aggregate("turns", none, masked, lambda s: s["loss"]).alias("loss"),
        F.size(F.filter("turns", lambda t: t["again"])).alias("n_repeated"), F.size("turns").alias("n_turns"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda n, t: n + t["tokens"]).alias("n_tokens"),
    )


def window_turns(windows: DataFrame) -> DataFrame:
    """The windows' own turns, read back from ``text``: ``turns`` (role, text), without the
    repeated ones; and ``said``, the text under the loss mask, unescaped."""
    lines = F.split("text", r"<\|im_end\|>\n")
    own = F.slice(lines, F.col("n_repeated") + 1, F.col("n_turns") - F.col("n_repeated"))

    def read(line: Column) -> Column:
        line = F.substr(line, F.lit(len(BEGIN) + 1))
        role = F.substring_index(line, "\n", 1)
        return F.struct(unescaped_role(role).alias("role"), unescaped(F.substr(line, F.length(role) + 2)).alias("text"))

    part = lambda s: unescaped(F.substr("text", (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int")))
    return windows.withColumn("turns", F.transform(own, read)).withColumn("said", F.array_join(F.transform("loss", part), ""))


def read_windows(windows: DataFrame) -> DataFrame:
    """Per conversation, read back from its windows: ``conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars``.

    A digest of a whole conversation needs its text in one row, so here, and here
    alone, a conversation's windows meet (Spark's limit is 2 GB)."""
    each = window_turns(windows)
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    each = each.select("conv_id", "start", F.size("turns").alias("n"), told.alias("told"), "said", F.length("text").alias("chars"))
    parts = F.sort_array(F.collect_list(F.struct("start", "told", "said")))
    convs = each.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), parts.alias("parts"))
    joined = lambda c: F.array_join(F.transform("parts", lambda p: p[c]), "")
    convs = convs.withColumn("told", joined("told")).withColumn("said", joined("said"))
    return convs.select(
        "conv_id", "n_turns", F.sha2("told", 256).alias("turns_sha256"), F.length("said").cast("long").alias("loss_chars"),
        F.sha2("said", 256).alias("loss_sha256"), "formatted_chars",
    )
