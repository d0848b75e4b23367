"""Chat formatting with SQL functions only: budgeted, turn-aligned windows with a loss mask.

Turns are numbered in order within their conversation, and tokens (one per started four
bytes of text and template) are summed before each turn.  These prefix sums choose the spans: a turn of at most
``stride`` tokens, a quarter of the budget, belongs to window floor(sum / stride), and a longer one, which ends such a span, stands
in a window alone.  So each window begins at a turn and its new turns have less than half of the budget, or are one
turn.  A window repeats the system turn, whatever its size, and as many of the last ``history_turns`` turns before its first
new one as what is left of the budget holds, ``history_tokens`` at most.  A window passes the budget only where the system
turn and a lone turn, or half of the budget, pass it by themselves.  Only new assistant turns are targets; repeated ones are masked.

Numbers and sums come in two steps, within groups of ``GROUP`` turn values and then
over the groups' totals, so that a conversation holding a third of all rows is
numbered by many tasks and only its totals meet.  Rows of one conversation and group of turn values are numbered by one task, which
sorts them on disk where they are many.  A window's rows are bounded by the budget.  The report of ``read_back`` hashes
whole conversations, so there a conversation must fit in a row.

A turn is formatted as ``<|turn|>``, its role, a line break, its text, ``<|end|>`` and a line break.
Inside texts and roles ``%`` becomes ``%25``, ``<|`` becomes ``<%7C``, ``|>`` becomes ``%7C>``, ``[INST]``
and ``</s>`` become ``%5BINST]`` and ``%3C/s>``, and so on, so that no control string is left; unescaping
turns these back.  Line breaks in roles are escaped too.

Defined cases: null role or text counts as empty; null turns come first; turns that tie are
ordered by role and text; repeated rows are turns of their own; a conversation without
assistant turns has an empty loss; null conversation ids form one conversation; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

START, END = "<|turn|>", "<|end|>\n"
BUDGET, HISTORY_TURNS, HISTORY_TOKENS = 1024, 2, 256
GROUP = 256
# Control strings of chat templates and what stands for them; the first must be the escape sign itself.
ESCAPES = (("%", "%25"), ("<|", "<%7C"), ("|>", "%7C>"), ("[INST]", "%5BINST]"), ("[/INST]", "%5B/INST]"), ("<s>", "%3Cs>"), ("</s>", "%3C/s>"), ("<<SYS>>", "%3C%3CSYS>>"), ("<</SYS>>", "%3C%3C/SYS>>"))


def escape(text: Column, role: bool = False) -> Column:
    for raw, safe in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return F.replace(text, F.lit("\n"), F.lit("%0A")) if role else text


def unescape(text: Column) -> Column:
    """Each escaped character back, the escape sign last."""
    for code, char in (("%7C", "|"), ("%5B", "["), ("%3C", "<"), ("%0A", "\n"), ("%25", "%")):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def numbered(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text) with seq (from 0) and before (tokens of all turns before it)."""
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("part", F.floor(F.coalesce(F.col("turn"), F.lit(-(1 << 40))) / GROUP))
    rows = rows.withColumn("body", F.concat(F.lit(START), escape(F.col("role"), True), F.lit("\n"), escape(F.col("text")), F.lit(END)))
    rows = rows.withColumn("tokens", F.ceil(F.octet_length("body") / 4).cast("bigint"))
    own = Window.partitionBy("conv_id", "part").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumn("at", F.row_number().over(own)).withColumn("sum", F.sum("tokens").over(own.rowsBetween(Window.unboundedPreceding, -1)))
    rows = written(rows.withColumn("sum", F.coalesce("sum", F.lit(0))), "turns")
    parts = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("conv_id", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n"), F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("t"))
    parts = written(parts, "parts").withColumnsRenamed({"conv_id": "_conv", "part": "_part"})
    joined = rows.join(parts, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part")))
    return joined.select("conv_id", "turn", "role", "text", "body", "tokens", (F.col("at") - 1 + F.col("n")).alias("seq"), (F.col("sum") + F.col("t")).alias("before"))


def windows(rows: DataFrame, budget: int = BUDGET, history_turns: int = HISTORY_TURNS, history_tokens: int = HISTORY_TOKENS) -> DataFrame:
    """(conv_id, window, first_seq, formatted, loss_spans, seqs, tokens): one row per window of every conversation.

    loss_spans are (start, length) in characters of formatted, from 0, around the escaped texts of new assistant turns.  Windows
    are numbered in order, with gaps."""
    stride = budget // 4
    window = 2 * F.floor(F.col("before") / stride).cast("bigint") + F.when(F.col("tokens") > stride, 1).otherwise(0)
    turns = numbered(rows).withColumn("window", window).withColumn("target", F.col("role") == "assistant")
    turns = written(turns.select("conv_id", "seq", "window", "target", "role", "body", "tokens", "before"), "windowed")
    keys = turns.groupBy("conv_id", "window").agg(F.min("seq").alias("first_seq"), F.min("before").alias("first_before"), F.sum("tokens").alias("own"))
    starts = written(keys.where("first_seq > 0"), "starts")
    system = turns.where("seq = 0 and role = 'system'").select(F.col("conv_id").alias("_conv"), F.col("tokens").alias("_system"))
    starts = starts.join(system, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    left = F.least(F.lit(history_tokens), F.lit(budget) - F.col("own") - F.coalesce("_system", F.lit(0)))
    # what a window may repeat: the turns just before it, within reach, and the system turn always
    near = F.transform(F.sequence(F.lit(1), F.lit(max(1, history_turns))), lambda k: F.struct((F.col("first_seq") - k).alias("_seq"), F.lit(False).alias("always")))
    near = F.filter(near, lambda x: F.lit(history_turns > 0) & ((x["_seq"] > 0) | ((x["_seq"] == 0) & F.col("_system").isNull())))
    first = F.when(F.col("_system").isNotNull(), F.array(F.struct(F.lit(0).cast("bigint").alias("_seq"), F.lit(True).alias("always")))).otherwise(F.array())
    wanted = starts.select(F.col("conv_id").alias("_conv"), F.col("window").alias("to_window"), "first_before", left.alias("left"), F.explode(F.concat(near, first)).alias("x")).select("*", "x.*").drop("x")
    again = turns.join(written(wanted, "wanted"), F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("seq") == F.col("_seq")))
    again = again.where(F.col("always") | (F.col("first_before") - F.col("before") <= F.col("left")))
    again = again.select("conv_id", F.col("to_window").alias("window"), "seq", "role", "body", F.lit(False).alias("target"), F.lit(False).alias("new"))
    rows = turns.select("conv_id", "window", "seq", "role", "body", "target", F.lit(True).alias("new")).unionByName(again)
    made = rows.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list(F.struct("seq", "body", "target", "new", F.length(escape(F.col("role"), True)).alias("head")))).alias("turns"))
    ends = F.aggregate(
        "turns",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda s, t: F.struct(
            (s["at"] + F.length(t["body"])).alias("at"),
            F.when(
                t["target"],
                F.concat(s["spans"], F.array(F.struct((s["at"] + len(START) + 1 + t["head"]).alias("start"), (F.length(t["body"]) - len(START) - 1 - t["head"] - len(END)).alias("length")))),
            ).otherwise(s["spans"]).alias("spans"),
        ),
        lambda s: s["spans"],
    )
    first = F.array_min(F.transform(F.filter("turns", lambda t: t["new"]), lambda t: t["seq"]))
    tokens = F.aggregate(F.transform("turns", lambda t: F.ceil(F.octet_length(t["body"]) / 4).cast("bigint")), F.lit(0).cast("bigint"), lambda a, b: a + b)
    return made.select("conv_id", "window", first.alias("first_seq"), F.array_join(F.transform("turns", lambda t: t["body"]), "").alias("formatted"), ends.alias("loss_spans"), F.transform("turns", lambda t: t["seq"]).alias("seqs"), tokens.alias("tokens"))


def read_back(formatted: DataFrame) -> DataFrame:
    """What windows say, per conversation: n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars.

    Turns are parsed out of the formatted text; repeated ones stand before the window's first new turn and are skipped."""
    pieces = F.slice(F.split("formatted", r"<\|turn\|>"), 2, 1 << 30)
    fresh = F.filter(F.arrays_zip(pieces.alias("piece"), F.col("seqs").alias("seq")), lambda x: x["seq"] >= F.col("first_seq"))

    def plain(piece: Column) -> Column:
        body = F.substring(piece, F.lit(1), F.length(piece) - len(END))
        cut = F.instr(body, "\n")
        return F.concat(unescape(F.substring(body, F.lit(1), cut - 1)), F.lit("\n"), unescape(F.substring(body, cut + 1, F.length(body))), F.lit("\n"))

    loss = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    rows = formatted.select(
        "conv_id",
        "window",
        F.size(fresh).cast("bigint").alias("n"),
        F.array_join(F.transform(fresh, lambda x: plain(x["piece"])), "").alias("turns"),
        F.array_join(loss, "").alias("loss"),
        F.length("formatted").cast("bigint").alias("chars"),
    )
    found = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("window", "turns", "loss"))).alias("w"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    whole = F.array_join(F.transform("w", lambda x: x["loss"]), "")
    return found.select(
        "conv_id",
        "n_turns",
        F.sha2(F.array_join(F.transform("w", lambda x: x["turns"]), "").cast("binary"), 256).alias("turns_sha256"),
        F.length(whole).cast("bigint").alias("loss_chars"),
        F.sha2(whole.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
