"""Continuous ingest."""

from .ingest import drain, ingest_stream

__all__ = ["drain", "ingest_stream"]
