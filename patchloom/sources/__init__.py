"""Readers, payload flattening and sinks."""
