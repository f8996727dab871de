"""Connectors: how records come in and go out, and what happens to those that cannot."""

from rivulet.sources.connectors.files import read_ndjson, write_ndjson
from rivulet.sources.connectors.pipeline import ConnectorConfig, SinkRunner, SourceRunner, dedup, dlq, fill_key, load_config, transform
from rivulet.sources.connectors.registry import SINKS, SOURCES

__all__ = ["SINKS", "SOURCES", "ConnectorConfig", "SinkRunner", "SourceRunner", "dedup", "dlq", "fill_key", "load_config", "read_ndjson", "transform", "write_ndjson"]
