"""Readers, sinks and table contracts."""
