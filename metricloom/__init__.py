"""Profiling, comparison and synthesis of metric telemetry on Spark."""
