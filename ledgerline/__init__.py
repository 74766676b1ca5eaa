"""Retail order-event and service-log analytics as Spark DataFrame pipelines."""
