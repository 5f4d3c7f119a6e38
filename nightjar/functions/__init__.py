"""Column-level building blocks (built-in Spark expressions only)."""
