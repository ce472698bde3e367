"""Address expressions."""
