"""Readers, generators and table sinks."""
