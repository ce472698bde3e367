"""Incremental ingestion of scans."""
