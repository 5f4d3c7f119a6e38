"""Structured Streaming jobs over landed query-log files (file source, no ports)."""
