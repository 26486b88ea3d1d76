"""Column functions of the record format."""

from .records import canonical_extra, encoded_size, hour, key_value, micros, rfc3339, to_timestamp, value_of

__all__ = ["canonical_extra", "encoded_size", "hour", "key_value", "micros", "rfc3339", "to_timestamp", "value_of"]
