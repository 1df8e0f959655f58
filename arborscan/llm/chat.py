"""Conversations as event logs: folded into final messages, then rendered with a loss mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# fixed values of the template: the strings that mark turns, and what stands for each inside a text
CONTROLS = [("<s>", "&lt;s>"), ("</s>", "&lt;/s>"), ("[INST]", "&#91;INST]"), ("[/INST]", "&#91;/INST]")]
OPEN, MIDDLE, CLOSE = "<s>[INST] ", " [/INST]", "</s>"
TRAINED = "assistant"

#: Event kinds: a new message; more text for it; its text replaced; its text thrown away to be written again.
KINDS = ("message", "delta", "edit", "regenerate")


def escape(text: Column) -> Column:
    """``text`` without control strings; ``unescape`` gives it back. ``&`` is escaped first, so every mark is unambiguous."""
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for control, mark in CONTROLS:
        out = F.replace(out, F.lit(control), F.lit(mark))
    return out


def unescape(text: Column) -> Column:
    out = text
    for control, mark in reversed(CONTROLS):
        out = F.replace(out, F.lit(mark), F.lit(control))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, messages array<struct<seq, role, text>>) of a log (conv_id, message, seq, kind, role, text).

    Events of a message are taken by seq, then kind, role and text, nulls first. ``message`` begins
    a message (a second one with the same key begins another); ``delta`` appends; ``edit`` and
    ``regenerate`` drop the text so far and go on with their own, so a regeneration is followed by
    new deltas. Events before any ``message`` begin one themselves. A null text is empty, a null
    role empty unless a later event of the message names one. A message takes its place in the
    conversation by the seq of its first event; null conversation ids are one conversation.

    Messages are folded first, spread over all of a conversation's tasks; only final texts meet at
    the conversation. Extra columns are left out. An empty log gives an empty table.
    """
    event = F.struct("seq", "kind", "role", "text")
    logs = events.groupBy("conv_id", "message").agg(F.array_sort(F.collect_list(event)).alias("log"))
    n = F.size("log")
    starts = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.element_at("log", i)["kind"] == "message"))
    ends = F.concat(F.slice("starts", 2, F.size("starts")), F.array(n + 1))
    spans = F.transform(F.arrays_zip(F.col("starts").alias("a"), F.col("ends").alias("b")),
                        lambda s: F.slice("log", s["a"], s["b"] - s["a"]))

    def folded(span: Column) -> Column:
        last = F.array_max(F.transform(F.sequence(F.lit(1), F.size(span)), lambda i: F.when(
            (i == 1) | F.element_at(span, i)["kind"].isin("edit", "regenerate"), i).otherwise(1)))
        texts = F.transform(F.slice(span, last, F.size(span)), lambda e: F.coalesce(e["text"], F.lit("")))
        roles = F.filter(F.transform(span, lambda e: e["role"]), lambda r: r.isNotNull())
        return F.struct(F.element_at(span, 1)["seq"].alias("seq"),
                        F.when(F.size(roles) > 0, F.element_at(roles, -1)).otherwise("").alias("role"),
                        F.array_join(texts, "").alias("text"))

    messages = (logs.withColumn("starts", starts).withColumn("ends", ends)
                .select("conv_id", F.transform(spans, folded).alias("messages")))
    return messages.groupBy("conv_id").agg(F.array_sort(F.flatten(F.collect_list("messages"))).alias("messages"))


def render(conversations: DataFrame, trained: str = TRAINED) -> DataFrame:
    """(conv_id, formatted, segments array<struct<text, loss>>) of folded conversations.

    The segments, one after another, are the formatted text; ``loss`` marks those to train on, that
    is exactly the escaped texts of the ``trained`` role.
    """
    segments = F.flatten(F.transform("messages", lambda m: F.array(
        F.struct(F.concat(F.lit(OPEN), escape(m["role"]), F.lit(MIDDLE)).alias("text"), F.lit(False).alias("loss")),
        F.struct(escape(m["text"]).alias("text"), (m["role"] == trained).alias("loss")),
        F.struct(F.lit(CLOSE).alias("text"), F.lit(False).alias("loss")))))
    return conversations.select("conv_id", segments.alias("segments")).select(
        "conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def turns(formatted: Column) -> Column:
    """The turns array<struct<role, text>> read back from a formatted conversation."""
    pieces = F.split(formatted, CLOSE)
    whole = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))
    return F.transform(whole, lambda p: F.struct(
        unescape(F.substring(F.substring_index(p, MIDDLE, 1), len(OPEN) + 1, 1 << 30)).alias("role"),
        unescape(F.substring(p, F.length(F.substring_index(p, MIDDLE, 1)) + len(MIDDLE) + 1, 1 << 30)).alias("text")))


def trained_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def rows_as_events(rows: DataFrame) -> DataFrame:
    """Finished turns (conv_id, turn, role, text) as a log of one ``message`` event each."""
    return rows.select("conv_id", F.col("turn").alias("message"), F.col("turn").alias("seq"), F.lit("message").alias("kind"), "role", "text")
