"""Readers, writers and the mapping from the given tables to event tables."""
