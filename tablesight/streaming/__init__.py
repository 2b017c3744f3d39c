"""Structured Streaming forms of the conversation operators."""

from .chat import message_counts_stream, recent_context_stream  # noqa: F401
