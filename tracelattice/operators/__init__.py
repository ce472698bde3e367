"""Path reconstruction and graph statistics."""
