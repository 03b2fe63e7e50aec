"""Sensor telemetry on Spark: ingest, one-second rollups, time-range syntheses."""
