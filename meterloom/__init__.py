"""meterloom: telemetry ingest and time-series shaping as plain Spark DataFrame functions."""

__version__ = "0.1.0"
