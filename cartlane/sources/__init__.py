"""Inputs and outputs: the raw clickstream schema, readers, adapter, sinks."""

from cartlane.sources.raw_events import RAW_EVENTS_SCHEMA, read_raw_events
from cartlane.sources.fixture import adapt_events, load_raw_events
from cartlane.sources.sinks import write_result, read_result
from cartlane.sources.history_store import read_history, write_history
from cartlane.sources.clustered import by_user, clustered_history, read_clustered, write_clustered
from cartlane.sources.rejects import read_accepted, read_rejects, write_checked

__all__ = ["RAW_EVENTS_SCHEMA", "read_raw_events", "adapt_events", "load_raw_events",
           "write_result", "read_result", "write_history", "read_history", "write_clustered", "read_clustered",
           "by_user", "clustered_history", "write_checked", "read_accepted", "read_rejects"]
