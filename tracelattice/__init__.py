"""Traceroute graph analytics on Spark: scans, path reconstruction and graph statistics."""
