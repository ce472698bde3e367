"""Scan readers and table sinks."""
