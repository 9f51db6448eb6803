"""Incremental processing: what is done is not done again, in batch and in Structured Streaming."""
