"""tidelake: a time-series ingestion lake and corpus toolkit on PySpark."""

__version__ = "0.1.0"
