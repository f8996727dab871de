"""Continuous queries and materialized views on Structured Streaming."""
