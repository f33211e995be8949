"""Halyard: a PySpark-native analytics engine for event, telemetry and corpus data."""
