"""Sensor-panel preparation, forecasting and scoring as Spark DataFrame jobs."""
