"""Sources of records: lines of JSON and binary frames."""

from .frames import decode_frames, encode_frame, read_frames
from .ndjson import parse_lines, read_ndjson

__all__ = ["decode_frames", "encode_frame", "parse_lines", "read_frames", "read_ndjson"]
