"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

An event log has conv_id, seq, turn, kind, role and text. Kinds: "message" (the whole text of a turn),
"delta" (more text of a turn), "edit" (a turn's text anew) and "regenerate" (a turn starts over; its
deltas follow). Events fold into final messages, which render into one string per conversation.

The template puts each turn between control strings:

    <|turn|>role NEWLINE text <|end|> NEWLINE

and an assistant's text, which is what the loss covers, between <|loss|> and <|/loss|>. Inside roles
and texts a backslash is written \\e, "<" is \\l and "[" is \\b (a role's newline is \\n), so no control
string of this or of the common bracket templates can come from a text, and reading back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EVENT_COLUMNS = ("conv_id", "seq", "turn", "kind", "role", "text")
STARTS = ("message", "edit", "regenerate")
CUTS = ("edit", "regenerate")
#: What stands for what, in the order of escaping; reading back goes the other way.
ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"))
TURN, END, LOSS, LOSS_END = "<|turn|>", "<|end|>\n", "<|loss|>", "<|/loss|>"


def escaped(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def messages_as_events(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) of finished messages as events, in the order of turn.

    Rows of one conversation with equal turns are all kept, ordered by role and text; nulls come
    first. seq and turn of the events count from 1.
    """
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    n = F.row_number().over(order).cast("long")
    return rows.select("conv_id", n.alias("seq"), n.alias("turn"), F.lit("message").alias("kind"), "role", "text")


def fold(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, turn, role, text.

    An edit or a regeneration of a turn drops what later turns had before it (that branch was
    abandoned). A turn's text is what its last message, edit or regenerate and the deltas after it
    say, in the order of seq; its role is the last one that any of its events names. Events that repeat exactly count
    once. A null text is empty, a null role stays null if no event names one, null conv_id is one
    conversation, null seq or turn counts as before all others. No events give no messages; other
    columns are not read.
    """
    e = events.select(
        "conv_id",
        F.coalesce(F.col("seq").cast("long"), F.lit(-(1 << 62))).alias("seq"),
        F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 62))).alias("turn"),
        "kind",
        "role",
        F.coalesce("text", F.lit("")).alias("text"),
    )
    earlier = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("cut", F.max(F.when(F.col("kind").isin(*CUTS), F.col("seq"))).over(earlier))
    e = e.where(F.col("cut").isNull() | (F.col("seq") > F.col("cut")))
    turn = Window.partitionBy("conv_id", "turn")
    e = e.withColumn("start", F.max(F.when(F.col("kind").isin(*STARTS), F.col("seq"))).over(turn))
    e = e.withColumn("role", F.max_by("role", F.when(F.col("role").isNotNull(), F.col("seq"))).over(turn))
    e = e.where(F.col("start").isNull() | (F.col("seq") >= F.col("start")))
    parts = F.sort_array(F.collect_set(F.struct("seq", "kind", "text")))
    return e.groupBy("conv_id", "turn").agg(
        F.first("role").alias("role"),
        F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("text"),
    )


def render(messages: DataFrame, assistant: str = "assistant") -> DataFrame:
    """One row a conversation: conv_id, n_turns, formatted, loss_spans.

    loss_spans has the start (from 0) and length in code points of each assistant text as it stands in
    formatted. A conversation is one string in the end, so its rows meet in one task; until then
    rows are single messages.
    """
    role = F.replace(escaped(F.coalesce("role", F.lit(""))), F.lit("\n"), F.lit("\\n"))
    own = F.coalesce(F.col("role") == assistant, F.lit(False))
    text = escaped(F.coalesce("text", F.lit("")))
    m = messages.select(
        "conv_id",
        "turn",
        own.alias("own"),
        F.concat(F.lit(TURN), role, F.lit("\n"), F.when(own, F.lit(LOSS)).otherwise("")).alias("head"),
        text.alias("body"),
        F.concat(F.when(own, F.lit(LOSS_END)).otherwise(""), F.lit(END)).alias("tail"),
    ).withColumn("length", (F.length("head") + F.length("body") + F.length("tail")).cast("long"))
    before = F.coalesce(F.sum("length").over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    m = m.withColumn("start", before + F.length("head"))
    line = F.sort_array(F.collect_list(F.struct("turn", F.concat("head", "body", "tail").alias("shown"))))
    spans = F.sort_array(F.collect_list(F.when(F.col("own"), F.struct("start", F.length("body").cast("long").alias("length")))))
    return m.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"),
        F.array_join(F.transform(line, lambda x: x["shown"]), "").alias("formatted"),
        spans.alias("loss_spans"),
    )


def parse(formatted: Column) -> Column:
    """The turns in a rendered string: array of (role, text), read by its control strings alone."""
    shown = F.split(formatted, "<\\|turn\\|>")
    turns = F.slice(shown, F.lit(2), F.size(shown))

    def turn(shown: Column) -> Column:
        cut = F.instr(shown, "\n")
        body = F.substring(shown, cut + 1, F.length(shown) - cut - len(END))
        body = F.regexp_replace(body, "^<\\|loss\\|>|<\\|/loss\\|>$", "")
        role = F.replace(F.substring(shown, F.lit(1), cut - 1), F.lit("\\n"), F.lit("\n"))
        return F.struct(unescaped(role).alias("role"), unescaped(body).alias("text"))

    return F.transform(turns, turn)


def loss_texts(formatted: Column) -> Column:
    """The texts under the loss mask, read back and unescaped, in order."""
    return F.transform(F.regexp_extract_all(formatted, F.lit("<\\|loss\\|>([^<]*)<\\|/loss\\|>"), 1), unescaped)


def digest(rendered: DataFrame) -> DataFrame:
    """What a rendered conversation says when read back: counts and sha256 of turns and of the loss text."""
    turns = F.transform(parse(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join(loss_texts(F.col("formatted")), "")
    return rendered.select(
        "conv_id",
        F.size(F.split("formatted", "<\\|turn\\|>")).cast("long") - 1,
        F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    ).toDF("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
