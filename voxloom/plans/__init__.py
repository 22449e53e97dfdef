"""Volumes derived from the driver's tables by integer arithmetic, the same in Spark and DuckDB."""
