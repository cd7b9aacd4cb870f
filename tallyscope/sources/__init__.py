"""Readers, sinks and the mapping from raw tables to the panel contract."""
