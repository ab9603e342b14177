"""Incremental and streaming wrappers."""
