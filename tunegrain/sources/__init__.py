"""Readers for raw files, and the prepared-dataset store."""

from tunegrain.sources.loading import RawTable, load_file, load_paths

__all__ = ["RawTable", "load_file", "load_paths"]
