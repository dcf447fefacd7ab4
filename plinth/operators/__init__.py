"""Operators over graphs, taxonomies and reports."""
