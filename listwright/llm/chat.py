"""Chat formatting in budgeted windows, with DataFrame functions only.

A turn is written as ``<|im_start|>role<|im_sep|>text<|im_end|>`` and a line break. Control strings inside roles and texts are
broken by a backslash and original backslashes doubled, which ``unescape`` undoes, so whatever a text holds, the marks of the
output are those of the template.

A conversation becomes windows of whole turns within a token budget:

1. turns are ordered by (turn, system first, role, text) and the tokens before each one added up (``before``). A first turn
   whose role is ``system`` is the conversation's system turn; it stands in front of every window;
2. the sums cut conversations into blocks of ``BLOCK_BUDGETS`` budgets, at every size alike, so that no task holds a
   conversation of unbounded length; a conversation above ``limit`` turns is summed up in range-partitioned slices;
3. inside a block a window starts at the first turn that no longer fits. It repeats the turns before it whose tokens are within
   ``history`` (less where its first new turn needs the room, none over the border of a block) and ends where the budget does;
4. the loss mask of a window covers the text of its new assistant turns. Repeated turns have none, so each assistant
   text is learned once.

Tokens are counted by a regular expression (pieces of up to four letters, digits or signs beyond ASCII, or one ASCII sign), as the
main path has no tokenizer; ``tokens`` takes any other column expression over ``text``.

Defined cases: a null text or role is an empty one; null turns come last; rows with a null conv_id are one conversation;
repeated rows are turns of their own; a turn that exceeds the budget alone is a window by itself (with the system turn), marked
``over_budget``, never cut; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listwright.llm.common import pick
from listwright.operators.skew import GROUP_LIMIT, SLICE_GROUP, slices, split_hot
from listwright.session import stage

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Strings that no text may bring into the output: the template's own and those of other common templates.
CONTROL = [START, SEP, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
BUDGET, HISTORY, BLOCK_BUDGETS = 2048, 512, 64
TOKEN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]{1,4}|[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]"
#: Tokens of the marks of a turn.
MARKS = 4

_BROKEN = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL)


def escape(text: Column) -> Column:
    """Backslashes doubled, then one put behind the first sign of each control string."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"({_BROKEN})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def count_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN)).cast("long")


def _sums(turns: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """Adds ``before``, the tokens of the conversation's turns ahead, and ``place``, which orders equal turns."""
    calm, hot = split_hot(turns, ["conv_id"], limit)
    ahead = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    total = lambda w: F.coalesce(F.sum("tokens").over(ahead(w)), F.lit(0))
    summed = calm.withColumn("before", total(Window.partitionBy("conv_id").orderBy(*order)))
    if hot is None:
        return summed
    # (conversation, slice) rows carry the sum over the slices before, added up in two levels.
    cut = slices(hot, [F.col("conv_id"), *order], "chat-slices", limit)
    parts = cut.groupBy("conv_id", "_slice").agg(F.sum("tokens").alias("tokens")).withColumn("_group", F.floor(F.col("_slice") / SLICE_GROUP))
    groups = parts.groupBy("conv_id", "_group").agg(F.sum("tokens").alias("tokens"))
    groups = groups.select(F.col("conv_id").alias("_c"), F.col("_group").alias("_g"), total(Window.partitionBy("conv_id").orderBy("_group")).alias("_ahead"))
    inside = parts.withColumn("_inside", total(Window.partitionBy("conv_id", "_group").orderBy("_slice")))
    offsets = inside.join(groups, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_group") == F.col("_g")))
    offsets = offsets.select(F.col("conv_id").alias("_c"), F.col("_slice").alias("_s"), (F.col("_inside") + F.col("_ahead")).alias("_offset"))
    here = cut.withColumn("_here", total(Window.partitionBy("conv_id", "_slice").orderBy("_within")))
    joined = here.join(offsets, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_slice") == F.col("_s")))
    return summed.unionByName(joined.select(*turns.columns, (F.col("_here") + F.col("_offset")).alias("before")))


def _starts(budget: int, history: int) -> Column:
    """Over ``turns`` (array of role, text, tokens, before): where windows begin, as (at, base, history from, room)."""
    turns, system = F.col("turns"), F.coalesce(F.col("system.tokens"), F.lit(0))
    kind = "array<struct<at:int,from:int,base:bigint,room:bigint>>"

    def opened(i: Column, turn: Column) -> Column:
        spare = F.greatest(F.lit(0).cast("long"), F.least(F.lit(history).cast("long"), F.lit(budget) - system - turn["tokens"]))
        ahead = F.slice(turns, F.lit(1), i)
        start = F.size(F.filter(ahead, lambda x: x["before"] < turn["before"] - spare)).cast("int")
        held = F.when(start < i, turn["before"] - F.get(turns, start)["before"]).otherwise(F.lit(0).cast("long"))
        return F.struct(i.cast("int").alias("at"), start.alias("from"), turn["before"].alias("base"), (F.lit(budget) - system - held).cast("long").alias("room"))

    def step(windows: Column, i: Column) -> Column:
        turn, last = F.get(turns, i), F.get(windows, F.size(windows) - 1)
        fits = turn["before"] + turn["tokens"] - last["base"] <= last["room"]
        return F.when((F.size(windows) > 0) & fits, windows).otherwise(F.concat(windows, F.array(opened(i, turn))).cast(kind))

    return F.aggregate(F.sequence(F.lit(0), F.size(turns) - 1), F.array().cast(kind), step)


def _piece(turn: Column) -> Column:
    return F.concat(F.lit(START), turn["role"], F.lit(SEP), turn["text"], F.lit(END + "\n"))


def format_windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens: Callable[[Column], Column] = count_tokens, limit: int = GROUP_LIMIT) -> DataFrame:
    """One row per window: conv_id, window (tokens of the conversation before its first new turn, so windows sort by it), text,
    loss (array of start and length in characters of ``text``), n_turns, n_repeated (leading turns that an earlier window holds
    as new ones, the system turn included), n_tokens, over_budget."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = pick(conversations, "conv_id", "turn", "role", "text").select("conv_id", "turn", escape(blank("role")).alias("role"), escape(blank("text")).alias("text"))
    rows = rows.withColumn("tokens", tokens(F.col("text")) + F.lit(MARKS).cast("long"))
    order = [F.col("turn").asc_nulls_last(), (F.col("role") == "system").desc(), F.col("role"), F.col("text")]
    # Every turn has tokens, so one row of a conversation has none before it: its first.
    summed = stage(_sums(rows, order, limit), "chat-turns")
    first = (F.col("before") == 0) & (F.col("role") == "system")
    systems = summed.where(first).select(F.col("conv_id").alias("_c"), F.struct("role", "text", "tokens").alias("system"))
    body = summed.where(~first).withColumn("block", F.floor(F.col("before") / (budget * BLOCK_BUDGETS)))
    blocks = body.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(F.struct("before", "role", "text", "tokens"))).alias("turns"))
    joined = blocks.join(systems, F.col("conv_id").eqNullSafe(F.col("_c")), "left").drop("_c")
    spoken = body.select(F.col("conv_id").alias("_d")).distinct()
    alone = systems.join(spoken, F.col("_c").eqNullSafe(F.col("_d")), "left_anti")
    alone = alone.select(F.col("_c").alias("conv_id"), "system", F.lit(0).cast("long").alias("window"), F.array().cast(blocks.schema["turns"].dataType).alias("pieces"), F.lit(0).alias("old"))
    return _written(_windows(joined.withColumn("starts", _starts(budget, history))).unionByName(alone), budget)


def _windows(blocks: DataFrame) -> DataFrame:
    ends = F.transform("starts", lambda w, i: F.struct(w.alias("w"), F.coalesce(F.get(F.col("starts"), i + 1)["at"], F.size("turns")).alias("end")))
    cut = blocks.select("conv_id", "system", "turns", F.explode(ends).alias("x"))
    pieces = F.slice("turns", F.col("x.w.from") + 1, F.col("x.end") - F.col("x.w.from"))
    window = F.col("x.w.base") - F.coalesce(F.col("system.tokens"), F.lit(0))
    return cut.select("conv_id", "system", window.alias("window"), pieces.alias("pieces"), (F.col("x.w.at") - F.col("x.w.from")).alias("old"))


def _written(windows: DataFrame, budget: int) -> DataFrame:
    held = F.col("system").isNotNull()
    head = F.when(held, _piece(F.col("system"))).otherwise(F.lit(""))
    before = F.array_join(F.transform("pieces", _piece), "")
    texts = windows.select("*", head.alias("head"), before.alias("body"))
    kind = "array<struct<start:bigint,length:bigint>>"
    opening = lambda t: F.length(F.concat(F.lit(START), t["role"], F.lit(SEP)))
    numbered = F.transform("pieces", lambda t, i: F.struct(t.alias("t"), i.alias("i")))

    def step(state: Column, x: Column) -> Column:
        t, at = x["t"], state["at"]
        span = F.struct((at + opening(t)).cast("long").alias("start"), F.length(t["text"]).cast("long").alias("length"))
        learned = (t["role"] == "assistant") & (x["i"] >= F.col("old"))
        return F.struct((at + F.length(_piece(t))).cast("long").alias("at"), F.when(learned, F.concat(state["loss"], F.array(span))).otherwise(state["loss"]).cast(kind).alias("loss"))

    zero = F.struct(F.length("head").cast("long").alias("at"), F.array().cast(kind).alias("loss"))
    loss = F.aggregate(numbered, zero, step, lambda s: s["loss"])
    count = F.aggregate("pieces", F.coalesce(F.col("system.tokens"), F.lit(0)).cast("long"), lambda n, t: n + t["tokens"])
    whole = texts.select(
        "conv_id", "window", F.concat("head", "body").alias("text"), loss.alias("loss"), (F.size("pieces") + held.cast("int")).alias("n_turns"),
        (F.col("old") + (held & (F.col("window") > 0)).cast("int")).alias("n_repeated"), count.alias("n_tokens"),
    )
    return whole.withColumn("over_budget", F.col("n_tokens") > budget)


def read_turns(text: Column) -> Column:
    """The turns of a formatted text, as an array of (role, text) without escapes."""
    bodies = F.filter(F.split(text, re.escape(END + "\n")), lambda x: x != "")
    parts = lambda x: F.split(F.substr(x, F.lit(len(START) + 1)), re.escape(SEP), 2)
    return F.transform(bodies, lambda x: F.struct(unescape(parts(x)[0]).alias("role"), unescape(parts(x)[1]).alias("text")))


def learned(text: Column, loss: Column) -> Column:
    """The texts under the loss mask, in order and without escapes."""
    return F.transform(loss, lambda s: unescape(F.substr(text, (s["start"] + 1).cast("int"), s["length"].cast("int"))))


def digest(windows: DataFrame) -> DataFrame:
    """Per conversation what its windows say, read back from their texts: each turn once, each learned text once.

    A digest needs its conversation as one value, so a conversation is limited by the size of a cell.
    """
    new = F.slice(read_turns(F.col("text")), F.col("n_repeated") + 1, F.greatest(F.lit(0), F.col("n_turns") - F.col("n_repeated")))
    said = F.array_join(F.transform(new, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = windows.select(
        "conv_id", "window", said.alias("said"), F.size(new).cast("long").alias("n"), F.array_join(learned(F.col("text"), F.col("loss")), "").alias("learned"),
        F.length("text").cast("long").alias("chars"), "n_tokens",
    )
    joined = rows.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.array_sort(F.collect_list(F.struct("window", "said", "learned"))).alias("w"), F.sum("chars").alias("formatted_chars"),
        F.count(F.lit(1)).alias("n_windows"), F.sum("n_tokens").alias("n_tokens"),
    )
    whole = lambda f: F.array_join(F.transform("w", lambda x: x[f]), "")
    return joined.select(
        "conv_id", "n_turns", F.sha2(whole("said"), 256).alias("turns_sha256"), F.length(whole("learned")).cast("long").alias("loss_chars"),
        F.sha2(whole("learned"), 256).alias("loss_sha256"), "formatted_chars", "n_windows", "n_tokens",
    )
