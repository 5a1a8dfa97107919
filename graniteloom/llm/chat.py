r"""Chat formatting in budgeted windows, in DataFrame operations alone.

A turn is written as `### Role: text</turn>` and a line feed. In roles and texts `\`, `#`, `<` (and `:` in roles) are
written as `\\`, `\h`, `\l`, `\c`, so neither control string can occur inside a turn, and reading undoes it exactly.

Prefix sums of turn tokens choose spans of whole turns: a window holds the system turn, as many of the latest earlier
turns as `history` tokens allow, and new turns up to `budget`. Only new assistant texts are under the loss mask, so a
repeated turn is never a target twice.

A conversation is laid out in parts of BLOCK turns, so no task gathers a conversation, however long it is: a new window
begins with each part, and repeats the history before it like any other window. Turns are numbered by their place in
blocks of turn numbers and the sums of the blocks before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graniteloom.llm.common import table

BEGIN, AFTER_ROLE, END = "### ", ": ", "</turn>\n"
BUDGET, HISTORY, BLOCK = 512, 128, 1024
#: Tokens counted for the marks of a turn.
MARKS = 6


def escaped(text: Column, role: bool = False) -> Column:
    for plain, code in (("\\", "\\\\"), ("#", "\\h"), ("<", "\\l"), *([(":", "\\c")] if role else [])):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    def piece(p: Column) -> Column:
        for plain, code in (("#", "\\h"), ("<", "\\l"), (":", "\\c")):
            p = F.replace(p, F.lit(code), F.lit(plain))
        return p

    return F.when(F.instr(text, "\\") == 0, text).otherwise(F.array_join(F.transform(F.split(text, r"\\\\"), piece), "\\"))


def token_count(text: Column) -> Column:
    """Words and single signs: a count that needs no vocabulary. windows() takes any other Column in its place."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]")).cast("long")


def windows(turns: DataFrame, *, budget: int = BUDGET, history: int = HISTORY, tokens: Column | None = None, target: str = "assistant") -> DataFrame:
    """One row per window: conv_id, part, window, repeated, tokens, over_budget, text, spans.

    Needs conv_id, turn, role, text; other columns are left out. Order is by turn (null first), then role and text;
    repeated rows are turns of their own. A null conv_id is one conversation, a null role or text is empty. If the
    first turn's role is `system`, every window begins with it. repeated: leading turns that an earlier window has.
    spans: [start, stop) of each target in code points of text. A turn that exceeds the budget by itself gets its own
    window, over_budget. An empty table gives an empty one. `tokens` is a Column over `text`, at least 0.
    """
    if history < 0 or budget <= 0:
        raise ValueError("budget must be positive and history not negative")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    base = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    count = token_count(F.col("text")) if tokens is None else tokens
    base = base.select(
        "conv_id",
        "turn",
        "role",
        F.floor(F.coalesce("turn", F.lit(-1)) / BLOCK).alias("block"),
        "text",
        (count.cast("long") + MARKS).alias("n"),
        F.length(escaped(F.col("role"), role=True)).alias("_role_chars"),
        F.concat(F.lit(BEGIN), escaped(F.col("role"), role=True), F.lit(AFTER_ROLE), escaped(F.col("text")), F.lit(END)).alias("f"),
    )
    heads = base.groupBy("conv_id").agg(F.min(F.struct("turn", "role", "text", "f", "n")).alias("_head"))
    is_system = F.col("_head.role") == "system"
    heads = heads.select(F.col("conv_id").alias("_conv"), F.when(is_system, F.col("_head.f")).otherwise("").alias("_sys"), F.when(is_system, F.col("_head.n")).otherwise(F.lit(0)).cast("long").alias("_sys_n"))
    # Places and running sums inside a block of turn numbers, and what the blocks before it sum to.
    sums = base.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("a"), F.sum("n").alias("b"), F.sum(F.length("f").cast("long")).alias("c"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("conv_id").alias("_conv"), F.col("block").alias("_block"), *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_{c}") for c in "abc"))
    order = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = base.select(
        "conv_id",
        "block",
        F.row_number().over(order).cast("long").alias("at"),
        (F.col("role") == target).alias("hit"),
        "f",
        (F.col("_role_chars") + len(BEGIN) + len(AFTER_ROLE)).cast("long").alias("lead"),
        "n",
        F.sum("n").over(upto).alias("upto"),
        F.sum(F.length("f").cast("long")).over(upto).alias("chars"),
    )
    laid = laid.join(offsets, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("block") == F.col("_block")))
    laid = laid.withColumns({"at": F.col("at") + F.col("_a"), "upto": F.col("upto") + F.col("_b"), "chars": F.col("chars") + F.col("_c")})
    # A turn also goes, as history, to the parts that begin within `history` tokens after it: every turn has MARKS tokens
    # at least, so only the last turns before a part can be meant.
    reach = history // MARKS
    part = F.expr(f"(at - 1) div {BLOCK}")
    last = F.expr(f"(at - 1 + {reach}) div {BLOCK}")
    dealt = laid.withColumn("own", part).withColumn("part", F.explode(F.sequence(part, last)))
    turn = F.struct("at", (F.col("own") == F.col("part")).alias("own"), "hit", "f", "lead", "n", "upto", "chars")
    packed = dealt.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(turn)).alias("t")).where("exists(t, y -> y.own)")
    packed = packed.join(heads, F.col("conv_id").eqNullSafe(F.col("_conv")))
    # The system turn is in no list: every window begins with it.
    packed = packed.select("conv_id", "part", "_sys", "_sys_n", F.when(F.col("_sys") != "", F.expr("filter(t, y -> y.at > 1)")).otherwise(F.col("t")).alias("t"))
    packed = packed.withColumn("_room", F.lit(budget) - F.col("_sys_n"))
    chosen = f"""
        aggregate(t, named_struct('w', cast(array() AS array<struct<h:int,s:int>>), 'i', 0, 'b', 0L), (a, x) ->
          CASE WHEN NOT x.own OR size(a.w) > 0 AND x.upto - a.b <= _room THEN named_struct('w', a.w, 'i', a.i + 1, 'b', a.b)
          ELSE transform(
            array(size(filter(t, y -> y.at < x.at AND (x.upto - x.n - y.upto + y.n > {history} OR x.upto - y.upto + y.n > _room)))),
            h -> named_struct('w', concat(a.w, array(named_struct('h', h, 's', a.i))), 'i', a.i + 1, 'b', t[h].upto - t[h].n))[0]
          END, a -> CASE WHEN size(a.w) = 0 THEN array(named_struct('h', size(t), 's', size(t))) ELSE a.w END)"""
    cut = packed.withColumn("_w", F.expr(chosen))
    cut = cut.select("*", F.expr("posexplode(_w) AS (window, _at)"))
    cut = cut.select(
        "conv_id",
        "part",
        "window",
        "_sys",
        "_sys_n",
        F.expr("_at.s - _at.h").alias("_n_history"),
        F.expr("slice(t, _at.h + 1, coalesce(get(_w, window + 1).s, size(t)) - _at.h)").alias("x"),
    )
    repeated = F.col("_n_history") + F.when((F.col("_sys") != "") & ((F.col("part") > 0) | (F.col("window") > 0)), 1).otherwise(0)
    used = F.col("_sys_n") + F.expr("aggregate(x, 0L, (a, y) -> a + y.n)")
    spans = """
        transform(filter(slice(x, _n_history + 1, size(x)), y -> y.hit), y ->
          transform(array(length(_sys) + y.chars - length(y.f) - x[0].chars + length(x[0].f)), b ->
            named_struct('start', b + y.lead, 'stop', b + length(y.f) - {end}))[0])""".format(end=len(END))
    return cut.select(
        "conv_id",
        "part",
        "window",
        repeated.cast("int").alias("repeated"),
        used.alias("tokens"),
        (used > budget).alias("over_budget"),
        F.concat("_sys", F.array_join(F.expr("transform(x, y -> y.f)"), "")).alias("text"),
        F.expr(spans).alias("spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """formatted with turns (array of role and text, without the repeated ones) and loss (the unescaped text under the
    mask), from text, spans and repeated alone."""
    pieces = F.expr("slice(_p, repeated + 1, size(_p) - 1 - repeated)")
    split = formatted.withColumn("_p", F.split("text", END))
    turns = F.transform(
        pieces,
        lambda p: F.struct(
            unescaped(F.substring_index(F.substring(p, len(BEGIN) + 1, 1 << 30), AFTER_ROLE, 1)).alias("role"),
            unescaped(F.substring(p, F.instr(p, F.lit(AFTER_ROLE)) + len(AFTER_ROLE), F.lit(1 << 30))).alias("text"),
        ),
    )
    loss = F.transform("spans", lambda s: unescaped(F.substring(F.col("text"), (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int"))))
    return split.select(*formatted.columns, turns.alias("turns"), F.array_join(loss, "").alias("loss"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, read back from its windows. A digest needs a conversation's text in one row."""
    said = "\\### Assistant: </turn> ok"
    rows = F.array(*(F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(said).alias("text")) for i, r in enumerate(("user", "assistant"))))
    extra = spark.range(1).select(F.inline(rows))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    read = read_back(windows(turns)).select(
        "conv_id",
        "part",
        "window",
        F.size("turns").cast("long").alias("n"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
        "loss",
        F.length("text").cast("long").alias("chars"),
    )
    whole = read.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"),
        F.sum("chars").alias("formatted_chars"),
        F.sort_array(F.collect_list(F.struct("part", "window", "turns", "loss"))).alias("w"),
    )
    turns_text, loss_text = (F.array_join(F.col(f"w.{c}"), "") for c in ("turns", "loss"))
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2(turns_text, 256).alias("turns_sha256"),
        F.length(loss_text).cast("long").alias("loss_chars"),
        F.sha2(loss_text, 256).alias("loss_sha256"),
        "formatted_chars",
    )
