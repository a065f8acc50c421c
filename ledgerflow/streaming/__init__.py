"""Structured Streaming counterparts of the batch operators."""
from .buckets import stream_bucket_aggregate, run_to_table

__all__ = ["stream_bucket_aggregate", "run_to_table"]
