"""Conversation-study analytics on Spark: surveys, token totals, regression, chat turn logs."""

__version__ = "0.1.0"
