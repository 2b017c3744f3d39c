"""Conversation-log operators over ``(conv_id, turn, role, text)`` tables.

Whole conversations are never collected into one value: the model input and
the Markdown export are long tables ``(conv_id, seq, ...)`` whose order is
``seq``; only the bounded "last n messages" context is aggregated to text,
and its ``row_number() <= n`` is planned with a partial WindowGroupLimit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The export's title line, speaker headings and separator,
# and the recent-context shape (last 6 messages, 400 characters each).
EXPORT_TITLE = "# AI Mentor Chat Export\n"
USER_HEADING = "You"
OTHER_HEADING = "AI Mentor"
EXPORT_SEPARATOR = "\n---\n\n"
RECENT_MESSAGES = 6
RECENT_CHARS = 400
PROFILE_CONTEXT = "\n\nContext — User's Dataset Profile:\n"


def recent_context(conv: DataFrame, n: int = RECENT_MESSAGES, max_chars: int = RECENT_CHARS) -> DataFrame:
    """``(conv_id, context)``: the last ``n`` messages in order, each
    ``ROLE: `` + the first ``max_chars`` characters, joined by newlines."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    last = conv.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
    line = F.concat(F.upper("role"), F.lit(": "), F.substring(F.coalesce("text", F.lit("")), 1, max_chars))
    return (last.select("conv_id", "turn", line.alias("line")).groupBy("conv_id")
                .agg(F.expr("listagg(line, '\\n') within group (order by turn)").alias("context")))


def model_messages(conv: DataFrame, system: str = "", profile: str | None = None) -> DataFrame:
    """``(conv_id, seq, role, content)``: the system message (seq -1, with
    the profile text appended when given) followed by the whole history in
    turn order (seq = turn)."""
    sys_text = system + (PROFILE_CONTEXT + profile if profile else "")
    head = conv.select("conv_id").distinct().select(
        "conv_id", F.lit(-1).cast("long").alias("seq"), F.lit("system").alias("role"),
        F.lit(sys_text).alias("content"))
    body = conv.select("conv_id", F.col("turn").cast("long").alias("seq"), "role", F.col("text").alias("content"))
    return head.unionByName(body)


def markdown_blocks(conv: DataFrame) -> DataFrame:
    """``(conv_id, seq, block)``: the export file of each conversation is its
    blocks in ``seq`` order joined by the separator (``sinks.write_chat_exports``
    writes them); seq -1 is the title."""
    head = conv.select("conv_id").distinct().select("conv_id", F.lit(-1).cast("long").alias("seq"),
                                                    F.lit(EXPORT_TITLE).alias("block"))
    who = F.when(F.col("role") == "user", USER_HEADING).otherwise(OTHER_HEADING)
    body = conv.select("conv_id", F.col("turn").cast("long").alias("seq"),
                       F.concat(F.lit("## "), who, F.lit("\n\n"), F.col("text"), F.lit("\n")).alias("block"))
    return head.unionByName(body)


def message_counts(conv: DataFrame) -> DataFrame:
    """``(conv_id, messages)``."""
    return conv.groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"))


def since_reset(conv: DataFrame, marker_role: str = "system") -> DataFrame:
    """Messages after the last reset marker (a ``marker_role`` message) of
    each conversation; conversations without a marker keep everything.
    Per-conversation maxima are grouped (partial aggregation) and joined back."""
    last = (conv.filter(F.col("role") == marker_role).groupBy("conv_id")
                .agg(F.max("turn").alias("_reset")))
    from .common import join_back
    return (join_back(conv, last, ["conv_id"])
                .filter(F.col("_reset").isNull() | (F.col("turn") > F.col("_reset")))
                .drop("_reset"))


def append_turns(conv: DataFrame, new: DataFrame) -> DataFrame:
    """Append ``(conv_id, pos, role, text)`` messages after each conversation's
    last turn. ``pos`` is the 0-based order of a message among the new ones of
    its conversation; the new turns are ``last + 1 + pos``. Rows of a table
    have no order of their own, so ``pos`` is required."""
    if "pos" not in new.columns:
        raise ValueError("append_turns: the new messages need a column pos")
    from .common import join_back
    last = conv.groupBy("conv_id").agg(F.max("turn").alias("_last"))
    add = new.withColumn("_o", F.col("pos").cast("long") + 1)
    add = join_back(add, last, ["conv_id"]).select(
        "conv_id", (F.coalesce("_last", F.lit(-1)) + F.col("_o")).cast(conv.schema["turn"].dataType).alias("turn"),
        "role", "text")
    return conv.unionByName(add)
