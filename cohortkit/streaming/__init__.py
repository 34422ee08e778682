"""Structured Streaming entry points."""

from cohortkit.streaming.responses import validate_stream

__all__ = ["validate_stream"]
