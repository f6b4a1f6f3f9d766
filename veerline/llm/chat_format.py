"""Chat formatting into budgeted windows.

A turn is written as ``<|im_start|>role`` line feed ``text<|im_end|>`` line feed; control strings
inside texts and roles are escaped reversibly. Turns cost tokens (a quarter of their characters,
rounded up), and the running sum of the costs places them: a turn is new in the window
``floor(tokens before it / stride)``, so windows are aligned to turns and each turn is new once. A
window also repeats its conversation's system turn and the last turns before it that lie within
``history`` tokens. Loss covers the texts of new assistant turns; repeated ones are masked.

The stride of a conversation leaves room for its system turn, history and longest turn, so a window
stays within ``budget``; a window whose new turns leave less room gets less history, and only a
window that holds a turn of nearly the whole budget is longer (turns are never cut).

All built-in column expressions. Scale: running sums are taken in two steps (sums of runs of
``run`` turn numbers, combined before the shuffle, then inside a run), so a hot conversation is
spread over its runs; the placed turns are written once and read by each use; a window's turns are
a group bounded by the budget; a turn is repeated at most ``1 + 8 * history / budget`` times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veerline.llm.common import id_key, written

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    """One more backslash between each '<' and '|' (that have only backslashes between them)."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """A role is one line: line feeds and percent signs are written as %0A and %25."""
    return F.replace(F.replace(escape(role), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))


def format_windows(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                   text_col: str = "text", budget: int = 1024, history: int = 256, run: int = 64) -> DataFrame:
    """One row per window: ``conv_id``, ``window`` (ascending within a conversation, with gaps), ``tokens``,
    ``repeated`` (leading turns that are repeated), ``n_turns``, ``formatted`` and ``loss`` (spans of
    ``formatted`` under the loss: offset and length in characters).

    Turns are ordered by number, then role, then text (null numbers first); equal rows are turns of
    their own. Null text or role: empty. Null conversation: a conversation of its own. Empty table: no
    windows."""
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    body = escape(text)
    head = F.concat(F.lit(START), escape_role(role), F.lit("\n"))
    rows = turns.select(id_key(F.col(conv_col)).alias("k"), F.col(conv_col).alias("conv_id"),
                        F.col(turn_col).alias("turn"), role.alias("role"), body.alias("body"), head.alias("head"))
    rows = rows.withColumn("tokens", F.ceil((F.char_length("head") + F.char_length("body") + len(END) + 1) / 4).cast("bigint"))
    rows = rows.withColumn("seg", F.coalesce(F.floor(F.col("turn") / run), F.lit(-(2 ** 62))).cast("bigint"))

    # tokens before each turn: sums of runs, then inside the run
    prior = Window.partitionBy("k").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    runs = (rows.groupBy("k", "seg").agg(F.sum("tokens").alias("n"))
            .select("k", "seg", F.coalesce(F.sum("n").over(prior), F.lit(0)).alias("before")))
    inside = Window.partitionBy("k", "seg").orderBy("turn", "role", "body").rowsBetween(Window.unboundedPreceding, -1)
    rows = (rows.join(runs, ["k", "seg"])
            .withColumn("start", F.col("before") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))).drop("seg", "before"))

    system = F.col("role") == "system"
    convs = rows.groupBy("k").agg(F.max("conv_id").alias("conv_id"), F.max("tokens").alias("longest"),
                                  F.min(F.when(system, F.struct("start", "tokens"))).alias("sys"))
    need = F.coalesce(F.col("sys.tokens"), F.lit(0)) + F.col("longest")
    stride = F.greatest(F.lit(budget - history) - need, F.lit(max(1, budget // 8)))
    convs = convs.select("k", "conv_id", F.col("sys.start").alias("sys_at"), stride.alias("stride"),
                         F.coalesce(F.col("sys.tokens"), F.lit(0)).alias("sys_tokens"))
    convs = written(convs, "conversations")         # a join with its own written aggregate: a hot conversation can be split
    rows = rows.drop("conv_id").join(convs, "k").withColumn("w", F.floor(F.col("start") / F.col("stride")))
    rows = written(rows.select("k", "conv_id", "w", "start", "stride", "sys_tokens", "sys_at", "tokens", "role", "head", "body"), "turns")
    room = F.lit(budget) - F.max("sys_tokens") - F.sum("tokens")
    windows = rows.groupBy("k", "w").agg(F.min("start").alias("first"),
                                         F.least(F.greatest(room, F.lit(0)), F.lit(history)).alias("reach"))

    item = F.struct("start", "tokens", "head", "body", (F.col("role") == "assistant").alias("target"))
    turn = rows.select("k", "conv_id", "w", "start", "stride", "sys_at", item.alias("t"))
    new = turn.select("k", "conv_id", "w", F.lit(2).alias("kind"), "t")
    last = F.floor((F.col("start") + F.lit(history)) / F.col("stride"))
    later = F.when(last > F.col("w"), F.sequence(F.col("w") + 1, last)).otherwise(F.array().cast("array<bigint>"))
    again = (turn.where(F.col("sys_at").isNull() | (F.col("start") != F.col("sys_at")))
             .select("k", "conv_id", "start", "t", F.explode(later).alias("w")).join(windows, ["k", "w"])
             .where(F.col("first") - F.col("start") <= F.col("reach")).select("k", "conv_id", "w", F.lit(1).alias("kind"), "t"))
    kept = (turn.where(F.col("start") == F.col("sys_at")).select("k", "conv_id", "start", "t").join(windows, "k")
            .where(F.col("first") > F.col("start")).select("k", "conv_id", "w", F.lit(0).alias("kind"), "t"))

    # the system turn, then history, then new turns, each in order
    per = (new.unionByName(again).unionByName(kept).groupBy("k", "w")
           .agg(F.max("conv_id").alias("conv_id"),
                F.array_sort(F.collect_list(F.struct("kind", F.col("t.start").alias("start"), F.col("t").alias("t")))).alias("items")))
    length = lambda x: F.char_length(x["t"]["head"]) + F.char_length(x["t"]["body"]) + len(END) + 1
    span = F.struct(F.lit(0).cast("int").alias("offset"), F.lit(0).cast("int").alias("length"))
    zero = F.struct(F.lit(0).cast("int").alias("at"), F.filter(F.array(span), lambda x: F.lit(False)).alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        own = F.array(F.struct((acc["at"] + F.char_length(x["t"]["head"])).alias("offset"),
                               F.char_length(x["t"]["body"]).alias("length")))
        masked = (x["kind"] < 2) | ~x["t"]["target"]
        return F.struct((acc["at"] + length(x)).alias("at"),
                        F.when(masked, acc["spans"]).otherwise(F.concat(acc["spans"], own)).alias("spans"))

    return per.select(
        "conv_id", F.col("w").alias("window"),
        F.aggregate("items", F.lit(0).cast("bigint"), lambda a, x: a + x["t"]["tokens"]).alias("tokens"),
        F.size(F.filter("items", lambda x: x["kind"] < 2)).alias("repeated"), F.size("items").alias("n_turns"),
        F.array_join(F.transform("items", lambda x: F.concat(x["t"]["head"], x["t"]["body"], F.lit(END + "\n"))), "").alias("formatted"),
        F.aggregate("items", zero, step)["spans"].alias("loss"))


def read_back(windows: DataFrame) -> DataFrame:
    """The new turns of each window, parsed from ``formatted`` alone (and the counts beside it):
    ``conv_id``, ``window``, ``turns`` (array of role and text, unescaped), ``loss_text`` (unescaped)."""
    parts = F.slice(F.split("formatted", r"<\|im_start\|>"), F.col("repeated") + 2, F.col("n_turns"))

    def turn(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        rest = F.char_length(role) + 1
        return F.struct(unescape_role(role).alias("role"),
                        unescape(F.substring(p, rest + 1, F.char_length(p) - rest - len(END) - 1)).alias("text"))

    loss = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["offset"] + 1, s["length"])))
    return windows.select("conv_id", "window", F.transform(parts, turn).alias("turns"), F.array_join(loss, "").alias("loss_text"),
                          F.char_length("formatted").alias("chars"))


def digest(windows: DataFrame) -> DataFrame:
    """One row per conversation, read back from the windows: ``conv_id``, ``n_turns``, ``turns_sha256``,
    ``loss_chars``, ``loss_sha256``, ``formatted_chars``. (A digest needs a conversation's whole text.)"""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    per = read_back(windows).select("conv_id", "window", F.size("turns").alias("n"), lines.alias("lines"), "loss_text", "chars")
    per = per.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"),
        F.array_sort(F.collect_list(F.struct("window", "lines", "loss_text"))).alias("ws"))
    join = lambda field: F.array_join(F.transform("ws", lambda x: x[field]), "")
    per = per.select("conv_id", "n_turns", join("lines").alias("turns"), join("loss_text").alias("loss"), "formatted_chars")
    return per.select("conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"),
                      F.char_length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                      F.col("formatted_chars").cast("bigint").alias("formatted_chars"))
