"""Readers for landed telemetry and feed files, and the versioned table store."""
