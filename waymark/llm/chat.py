"""Chat formatting into budgeted windows with a loss mask.

A conversation's turns are cut into spans by prefix sums of the turns' tokens:
a span takes turns as long as they fit the budget beside the system turn and,
behind the first span, the room for history.  A window is the system turn, the
last turns before the span that fit the history's room, and the span.  Spans are found on
the turns' numbers; texts are dealt by window, so no task holds a long
conversation's texts at once.  The loss
mask covers the texts of the span's assistant turns, so a repeated target is
never learned twice.

A turn is written <|im_start|>role<|im_sep|>text<|im_end|> and a line end.  In
roles and texts a backslash is doubled and <| becomes <\\|, so no control string
can stand in them, and unescape() gives them back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.native import let

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
BUDGET, HISTORY = 2048, 512


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\\")), F.regexp_replace(text, r"\\([\\|])", "$1")).otherwise(text)


def format_chats(df: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens: str | None = None, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", target: str = "assistant") -> DataFrame:
    """A row for each window: conv_id, window, formatted, n_turns, n_repeated, n_tokens, loss.

    loss lists start and length, in characters of formatted, of what is to be
    learned; the first n_repeated turns stand in an earlier window too.  A
    turn's tokens are the column `tokens`, else a fourth of its bytes as written,
    rounded up.  A single turn beyond the budget gets a window of its own.
    Null roles and texts count as empty.  Rows of equal conv_id and turn are all
    kept, ordered by role and text; a null turn comes first; null is a conv_id
    of its own.  Other columns are not read.  An empty table gives no windows.
    """
    empty = F.lit("")
    rows = df.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), empty).alias("role"), F.coalesce(F.col(text).cast("string"), empty).alias("text"), (F.coalesce(F.col(tokens).cast("long"), F.lit(0)) if tokens else F.lit(None).cast("long")).alias("tok"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("pos", F.row_number().over(order) - 1)
    rows = rows.withColumn("head", F.concat(F.lit(START), escape(F.col("role")), F.lit(SEP))).withColumn("body", escape(F.col("text")))
    rows = rows.withColumn("chars", F.char_length("head") + F.char_length("body") + len(END))
    rows = rows.withColumn("tok", F.coalesce("tok", F.ceil((F.octet_length("head") + F.octet_length("body") + len(END)) / 4)))
    rows = rows.withColumn("system", (F.col("pos") == 0) & (F.col("role") == "system"))
    # prefix sums: the tokens before each turn
    so_far = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("before", F.sum("tok").over(so_far) - F.col("tok"))
    # where spans begin, from numbers alone
    slim = F.sort_array(F.collect_list(F.when(~F.col("system"), F.struct("pos", "before", "tok"))))
    convs = rows.groupBy("conv_id").agg(slim.alias("t"), F.coalesce(F.max(F.when(F.col("system"), F.col("tok"))), F.lit(0)).alias("sys_tok"))
    zero = F.struct(F.lit(0).cast("long").alias("from"), F.expr("cast(array() as array<int>)").alias("begins"))

    def step(a: Column, x: Column) -> Column:
        room = F.lit(budget) - F.col("sys_tok") - F.when(F.size(a["begins"]) > 1, history).otherwise(0)
        fits = (F.size(a["begins"]) > 0) & (x["before"] + x["tok"] - a["from"] <= room)
        return F.when(fits, a).otherwise(F.struct(x["before"].alias("from"), F.array_append(a["begins"], x["pos"]).alias("begins")))

    begins = convs.select("conv_id", F.explode(F.aggregate("t", zero, step)["begins"]).alias("pos"), F.lit(0).alias("kind"))
    # marks of beginnings among the turns number the windows; a turn stands in its own and in those it is history of
    every = rows.withColumn("kind", F.lit(1)).unionByName(begins, allowMissingColumns=True)
    in_order = Window.partitionBy("conv_id").orderBy("pos", "kind")
    number = F.sum(1 - F.col("kind")).over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1
    every = every.withColumns({"own": number, "begins": F.lag("kind").over(in_order) == 0}).filter("kind = 1")
    every = every.withColumn("windows", F.max("own").over(Window.partitionBy("conv_id")) + 1)
    reach = F.max(F.when(F.col("begins"), F.col("own"))).over(Window.partitionBy("conv_id").orderBy("before").rangeBetween(0, history))
    last = F.when(F.col("system"), F.greatest(F.col("windows"), F.lit(1)) - 1).otherwise(F.greatest("own", reach))
    every = every.withColumns({"first": F.when(F.col("system"), F.lit(0)).otherwise(F.col("own")), "last": last})
    every = every.withColumn("window", F.explode(F.sequence("first", "last")))
    # from here on each window is by itself
    new = ~F.col("system") & (F.col("own") == F.col("window"))
    start = F.coalesce(F.sum("chars").over(Window.partitionBy("conv_id", "window").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    mask = F.struct((start + F.char_length("head")).cast("int").alias("start"), F.char_length("body").alias("length"))
    turns = every.select("conv_id", F.col("window").cast("int").alias("window"), "pos", F.concat("head", "body", F.lit(END)).alias("written"), "tok", F.when(new & (F.col("role") == target), mask).alias("mask"), ((F.col("window") > 0) & ~new).cast("int").alias("repeated"))
    windows = turns.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list(F.struct("pos", "written"))).alias("t"), F.count(F.lit(1)).cast("int").alias("n_turns"), F.sum("repeated").cast("int").alias("n_repeated"), F.sum("tok").alias("n_tokens"), F.sort_array(F.collect_list("mask")).alias("loss"))
    return windows.select("conv_id", "window", F.array_join("t.written", "").alias("formatted"), "n_turns", "n_repeated", "n_tokens", "loss")


def read_back(windows: DataFrame) -> DataFrame:
    """A row for each conversation of format_chats(): conv_id, turns (role, text), loss_text, formatted_chars, all from the written windows.

    Null conv_id is one conversation; empty roles and texts come back empty
    (null ones too); repeated turns come back as often as they were; a
    conversation of any length is one row; other columns are not
    read; no windows give no rows.
    """
    pieces = F.filter(F.split("formatted", r"<\|im_end\|>\n", -1), lambda p: p != "")
    turn = lambda p: F.struct(unescape(F.substring_index(F.substr(p, F.lit(len(START) + 1)), SEP, 1)).alias("role"), unescape(F.substring_index(p, SEP, -1)).alias("text"))
    turns = let(pieces, lambda a: F.transform(F.slice(a, F.col("n_repeated") + 1, F.greatest(F.size(a) - F.col("n_repeated"), F.lit(0))), turn))
    learned = F.array_join(F.transform("loss", lambda m: unescape(F.substr(F.col("formatted"), m["start"] + 1, m["length"]))), "")
    parts = windows.select("conv_id", F.struct("window", turns.alias("turns"), learned.alias("learned"), F.char_length("formatted").cast("long").alias("chars")).alias("w"))
    whole = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("w"))
    return whole.select("conv_id", F.flatten("w.turns").alias("turns"), F.array_join("w.learned", "").alias("loss_text"), F.aggregate("w.chars", F.lit(0).cast("long"), lambda a, x: a + x).alias("formatted_chars"))
