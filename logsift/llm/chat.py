"""Chat formatting from event logs, in DataFrame functions only.

A log has one event per row: conv_id, message (any type with an order: the place in the conversation), seq
(the order of events), kind, role, text. Kinds: ``delta`` appends its text to the message, ``edit`` replaces
the message's text, ``regenerate`` empties it for the deltas that follow. The fold of a message is then the
text from its last edit or regeneration on, so it needs neither state nor Python. Events are first grouped
by (conversation, message), which spreads a hot conversation; only the messages meet by conversation.

The template writes a turn as ``<|role|>text<|end|>``. Within roles and texts a backslash, ``<|`` and ``|>``
are escaped with a backslash, so the output holds control strings only where the template put them, and
``read_back`` gives every role and text unchanged. The loss mask names the assistant texts as code-point spans of the output.

Null texts and roles are empty ones; events that tie in seq apply in the order of kind and text; null ids are ids of their
own; a kind that is null or unknown counts as ``delta``. No events, no conversations. A conversation is rendered as one row, so its
text must stay below the 2 GB that a row can hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE, END = "<|", "|>", "<|end|>"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit(OPEN), F.lit("<\\|"))
    return F.replace(out, F.lit(CLOSE), F.lit("|\\>"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def reconstruct(events: DataFrame) -> DataFrame:
    """(conv_id, message, role, text): the final messages of an event log."""
    empty = F.lit("")
    event = F.struct("seq", "kind", F.coalesce("text", empty).alias("text"), "role")
    resets = F.col("kind").isin("edit", "regenerate")
    events = events.withColumn("kind", F.when(resets, F.col("kind")).otherwise("delta"))
    folded = events.groupBy("conv_id", "message").agg(F.array_sort(F.collect_list(event)).alias("e"))
    # Counted from the end: the last event that makes earlier text void, or 0.
    last = F.array_position(F.transform(F.reverse("e"), lambda x: x["kind"] != "delta"), True).cast("int")
    kept = F.when(last > 0, F.slice("e", F.size("e") - last + 1, last)).otherwise(F.col("e"))
    texts = F.transform(kept, lambda x: F.when(x["kind"] == "regenerate", empty).otherwise(x["text"]))
    roles = F.filter(F.transform("e", lambda x: x["role"]), lambda x: x.isNotNull())
    return folded.select(
        "conv_id",
        "message",
        F.coalesce(F.try_element_at(roles, F.lit(-1)), empty).alias("role"),
        F.array_join(texts, "").alias("text"),
    )


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, n_turns, formatted, loss_mask): every conversation in the template.

    loss_mask: spans (start, end) of ``formatted``, in code points, end exclusive.
    """
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(CLOSE))
    before = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    turn = F.concat("head", "body", F.lit(END))
    placed = (
        messages.select("conv_id", "message", "role", head.alias("head"), escape(F.col("text")).alias("body"))
        .withColumn("turn", turn)
        .withColumn("start", F.coalesce(F.sum(F.length("turn")).over(before), F.lit(0)) + F.length("head"))
    )
    span = F.when(
        F.col("role") == LOSS_ROLE,
        F.struct(F.col("start").alias("start"), (F.col("start") + F.length("body")).alias("end")),
    )
    turns = F.array_sort(F.collect_list(F.struct("message", "turn", span.alias("span"))))
    return placed.groupBy("conv_id").agg(turns.alias("turns")).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.col("turns.turn"), "").alias("formatted"),
        F.filter(F.col("turns.span"), lambda x: x.isNotNull()).alias("loss_mask"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, place, role, text, in_loss): the turns as the output alone tells them."""
    turns = F.split("formatted", r"<\|end\|>", -1)
    rows = formatted.select("conv_id", F.posexplode(F.slice(turns, 1, F.size(turns) - 1)).alias("place", "turn"))
    before = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    sizes = F.sum(F.length("turn") + len(END)).over(before)
    close = F.locate(CLOSE, F.col("turn"))
    found = rows.withColumn("start", F.coalesce(sizes, F.lit(0)) + close + len(CLOSE) - 1).select(
        "conv_id",
        "place",
        "start",
        unescape(F.substring("turn", F.lit(len(OPEN) + 1), close - len(OPEN) - 1)).alias("role"),
        F.substring("turn", close + len(CLOSE), F.length("turn")).alias("body"),
    )
    mask = formatted.select(F.col("conv_id").alias("of"), F.inline("loss_mask").alias("at", "end"))
    joined = found.join(mask, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("start") == F.col("at")), "left")
    inside = F.col("end").isNotNull() & (F.col("end") == F.col("start") + F.length("body"))
    return joined.select("conv_id", "place", "role", unescape(F.col("body")).alias("text"), inside.alias("in_loss"))


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation: counts and digests of what ``read_back`` finds in the output."""
    line = F.lit("\n")
    turn = F.struct("place", F.concat("role", line, "text", line).alias("turn"), F.when(F.col("in_loss"), F.col("text")).alias("loss"))
    read = read_back(formatted).groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    loss = F.array_join(F.col("turns.loss"), "")  # leaves out the nulls
    read = read.select(
        F.col("conv_id").alias("of"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.col("turns.turn"), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
    )
    sizes = formatted.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"))
    return sizes.join(read, F.col("conv_id").eqNullSafe(F.col("of"))).select(
        "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"
    )
