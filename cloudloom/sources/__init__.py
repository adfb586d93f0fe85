"""Readers and writers of point clouds, reports and decisions."""

from .readers import read_points, read_public_dataset
from .writers import write_grouped, write_report

__all__ = ["read_points", "read_public_dataset", "write_grouped", "write_report"]
