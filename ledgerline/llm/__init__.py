"""Operators for preparing training text: dedup, filtering, scanning, counting, packing."""
