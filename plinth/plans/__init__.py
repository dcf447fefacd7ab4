"""Vocabulary, and the graph view over the benchmark tables."""
