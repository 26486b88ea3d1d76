"""Read plans over published files."""

from .view import hour_bounds, scan, series_view, view_sql

__all__ = ["hour_bounds", "scan", "series_view", "view_sql"]
