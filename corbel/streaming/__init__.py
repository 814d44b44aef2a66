"""Streaming ingestion of call facts. The reference has no streams; this is an addition for continuous shard runs."""
