"""Sensor and forecast-accuracy analytics as Spark DataFrame and streaming operators."""
