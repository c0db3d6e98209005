"""Sensor-recording analytics as PySpark DataFrame operators."""
