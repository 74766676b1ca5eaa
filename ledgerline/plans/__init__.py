"""The staging, intermediate and mart models."""
