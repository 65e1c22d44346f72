"""Sensor-telemetry preparation, scoring, fault injection and drift monitoring as Spark DataFrame jobs."""
