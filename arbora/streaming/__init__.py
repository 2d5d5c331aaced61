"""Streaming of the reconciliation engine."""
