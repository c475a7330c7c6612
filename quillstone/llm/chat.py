r"""Chat formatting from an event log, with built-in functions only.

A log has one row per event: ``conv_id, seq, kind, message_id, role, text``.
Kinds: ``message`` (begins one, with text), ``delta`` (appends), ``edit``
(replaces the text), ``regenerate`` (starts the text anew and drops the
messages begun since), ``delete``.  Events of a conversation are folded in
order of ``seq`` into its final messages, and these are rendered:

    <|turn|>ROLE<|text|>TEXT<|end|>

Control strings (``<|...|>``, ``</s>``, ``[INST]`` and so on) inside roles and
texts get a backslash after their first character; one that has backslashes
there gets one more.  So the rendering holds no control string but its own,
and taking one backslash away gives the text back.

Nulls: a null text or role is empty; rows with a null conv_id are one
conversation of their own; a null seq comes first.  Events of equal seq are
taken by kind, role and text.  Equal rows are events of their own.  A
conversation is one row of the result, so one task holds it.  An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Control strings of common chat templates, after their first character.
CONTROL = r"\|[A-Za-z0-9_ /:.-]{0,60}\|>|/?(?:s|bos|eos|pad|unk|mask|start_of_turn|end_of_turn)>|</?SYS>>|/?INST\]"
_ESCAPE = rf"([<\[])(\\*)({CONTROL})"
_UNESCAPE = rf"([<\[])\\(\\*)({CONTROL})"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1$2$3")


def fold(events: DataFrame) -> DataFrame:
    """Final messages: ``conv_id, place, role, text``."""
    by_message = Window.partitionBy("conv_id", "message_id")
    restart = F.col("kind").isin("message", "edit", "regenerate")
    # the place of an event in its conversation settles ties of seq once
    order = Window.partitionBy("conv_id").orderBy("seq", "kind", "role", "text")
    log = events.select("conv_id", "seq", "kind", "message_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).withColumn("at", F.row_number().over(order))
    log = log.withColumn("base", F.max(F.when(restart, F.col("at"))).over(by_message))
    live = (F.col("at") >= F.coalesce("base", F.lit(0))) & F.col("kind").isin("message", "edit", "regenerate", "delta")
    texts = F.sort_array(F.collect_list(F.when(live, F.struct("at", "text"))))
    message = log.groupBy("conv_id", "message_id").agg(
        F.min("at").alias("place"),
        F.min_by("role", "at").alias("role"),
        F.array_join(F.transform(texts, lambda x: x["text"]), "").alias("text"),
        F.max(F.when(F.col("kind") == "regenerate", F.col("at"))).alias("again"),
        F.coalesce(F.max(F.when(F.col("kind") == "delete", F.col("at"))), F.lit(0)).alias("gone"),
        F.coalesce(F.max(F.when(restart, F.col("at"))), F.lit(0)).alias("base"),
    )
    before = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    cut = F.coalesce(F.max("again").over(before), F.lit(0))
    return message.withColumn("cut", cut).where("gone <= base and cut <= place").select("conv_id", "place", "role", "text")


def render(messages: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: ``conv_id, formatted, segments``; the segments, joined, are ``formatted``, and ``loss`` marks what is learned."""
    turn = F.struct(
        "place",
        F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT)).alias("head"),
        escape(F.col("text")).alias("body"),
        F.col("role").isin(*learn).alias("loss"),
    )

    def pieces(t: Column) -> Column:
        return F.array(
            F.struct(t["head"].alias("text"), F.lit(False).alias("loss")),
            F.struct(t["body"].alias("text"), t["loss"].alias("loss")),
            F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss")),
        )

    turns = messages.select("conv_id", turn.alias("turn")).groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    segments = turns.select("conv_id", F.flatten(F.transform("turns", pieces)).alias("segments"))
    return segments.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def format_log(events: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    return render(fold(events), learn)


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id, turns array<struct<role, text>>, loss_text, formatted``, parsed from the rendering and its mask."""
    cut = F.split("formatted", r"<\|end\|>", -1)
    pieces = formatted.select("conv_id", "formatted", "segments", F.filter(cut, lambda x: x != "").alias("pieces"))

    def turn(x: Column) -> Column:
        role = F.substring_index(x, TEXT, 1)
        return F.struct(
            unescape(F.regexp_replace(role, r"^<\|turn\|>", "")).alias("role"),
            unescape(F.regexp_replace(x, r"(?s)^<\|turn\|>.*?<\|text\|>", "")).alias("text"),
        )

    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    return pieces.select("conv_id", "formatted", F.transform("pieces", turn).alias("turns"), loss.alias("loss_text"))


def log_of_rows(rows: DataFrame) -> DataFrame:
    """Rows ``conv_id, turn, role, text`` as the log of a session that ends in them.

    A user's text comes as a message and a delta; an assistant's as a draft
    that is generated anew, streamed in two pieces; any other one as a message
    that an edit replaces.
    """
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    half = F.floor(F.length("text") / 2).cast("int")
    head, tail = F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.length("text"))

    def log(*steps: tuple[str, Column]) -> Column:
        return F.array(*[F.struct(F.lit(k).alias("step"), F.lit(kind).alias("kind"), text.alias("text")) for k, (kind, text) in enumerate(steps)])

    steps = (
        F.when(F.col("role") == "user", log(("message", head), ("delta", tail)))
        .when(F.col("role") == "assistant", log(("message", head), ("regenerate", head), ("delta", tail)))
        .otherwise(log(("message", head), ("edit", F.col("text"))))
    )
    given = rows.select("conv_id", place.cast("long").alias("message_id"), "role", F.coalesce("text", F.lit("")).alias("text"))
    each = given.select("conv_id", "message_id", "role", F.explode(steps).alias("e"))
    return each.select("conv_id", (F.col("message_id") * 4 + F.col("e.step")).alias("seq"), "e.kind", "message_id", "role", "e.text")
