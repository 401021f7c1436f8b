"""Frames over streams: verbs that need no row order run unchanged, the others are refused."""

from .streams import StreamFrame, stream_from, windowed

__all__ = ["StreamFrame", "stream_from", "windowed"]
