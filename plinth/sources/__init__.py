"""Readers, writers and the graph as relations."""
