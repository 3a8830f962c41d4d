"""Strict readers and single-file publishers."""
