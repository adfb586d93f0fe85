"""Structured Streaming: clouds that arrive block by block."""

from .accumulator import export_stream, voxel_stream

__all__ = ["export_stream", "voxel_stream"]
