"""Operators on records: validation and the flush."""

from .flush import deduplicate, flush_counts, landed_groups, sort_for_storage, to_storage
from .validate import WINDOW, accept_window, reject_reason, split, unit_of

__all__ = ["WINDOW", "accept_window", "deduplicate", "flush_counts", "landed_groups", "reject_reason", "sort_for_storage", "split", "to_storage", "unit_of"]
