"""Ebbline: tiered analytics on Spark (hot rows, a versioned lake, a correction overlay, one logical table)."""

__version__ = "0.1.0"
