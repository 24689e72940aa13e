"""Edges that arrive as a stream."""

from .edges import stream_degrees, stream_edges

__all__ = ["stream_degrees", "stream_edges"]
