"""Spark-native reconciliation of hierarchical documents."""
