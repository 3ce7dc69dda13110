"""Sources and sinks."""

from brookspan.sources.files import commit_partitions, csv_source, discard, file_sink, read_csv
from brookspan.sources.kafka import json_rows, kafka_sink, kafka_source, to_json_value
from brookspan.sources.nexmark import events as nexmark_events
from brookspan.sources.nexmark import tables as nexmark_tables

__all__ = [
    "commit_partitions", "csv_source", "discard", "file_sink", "json_rows", "kafka_sink", "kafka_source", "nexmark_events", "nexmark_tables",
    "read_csv", "to_json_value",
]
