"""Structured Streaming entry points (scoring of arriving files with a saved model)."""

from lucerna.streaming.scoring import score_stream, scoring_query

__all__ = ["score_stream", "scoring_query"]
