"""Sinks: split tables, matrices, manifests and reports."""
