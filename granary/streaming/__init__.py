"""Structured Streaming forms: ingestion, split, throughput, adaptive window, alerts, statistics."""
