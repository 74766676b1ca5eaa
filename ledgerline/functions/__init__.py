"""Column-valued helper functions."""
