"""Conversation logs arriving as a stream of ``(conv_id, turn, role, text)``
messages (the append side of the chat history).

- ``message_counts_stream``: running message count per conversation, a
  built-in streaming aggregate (update mode).
- ``recent_context_stream``: the "last 6 messages" context per
  conversation, kept with ``applyInPandasWithState``; the state of a
  conversation is at most ``n`` messages, however long it grows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.conversations import RECENT_CHARS, RECENT_MESSAGES


def message_counts_stream(stream: DataFrame) -> DataFrame:
    """``(conv_id, messages)``; use output mode ``update`` or ``complete``."""
    return stream.groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"))


def recent_context_stream(stream: DataFrame, n: int = RECENT_MESSAGES, max_chars: int = RECENT_CHARS) -> DataFrame:
    """``(conv_id, context)`` updated whenever a conversation receives
    messages; same text as ``conversations.recent_context`` (output mode
    ``update``). Messages may arrive out of order within and across batches;
    the state keeps the ``n`` highest turns seen."""

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        kept = json.loads(state.get[0]) if state.exists else []
        for b in batches:
            kept += [[int(t), f"{str(r).upper()}: {str(x)[:max_chars]}"]
                     for t, r, x in zip(b["turn"], b["role"], b["text"])]
            kept = sorted({t: line for t, line in kept}.items())[-n:]
            kept = [list(e) for e in kept]
        state.update((json.dumps(kept),))
        yield pd.DataFrame({"conv_id": [int(key[0])], "context": ["\n".join(line for _, line in kept)]})

    return stream.groupBy("conv_id").applyInPandasWithState(
        step, "conv_id long, context string", "recent string", "update", GroupStateTimeout.NoTimeout)
