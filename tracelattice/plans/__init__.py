"""Configuration, the pipeline and the registered queries."""
