"""nightjar: security telemetry analytics as plain Spark DataFrame jobs.

Vulnerability findings and DNS query logs are ingested, enriched, kept as
long-lived state through set-based transitions, ranked and scanned by
parameterised detections. Everything runs as DataFrame / SQL plans; no
Python UDFs sit in the hot path.
"""

__all__ = ["session"]
