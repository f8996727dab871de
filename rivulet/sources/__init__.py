"""Streams as logs of Parquet segments, their envelope, consumers and connectors."""
