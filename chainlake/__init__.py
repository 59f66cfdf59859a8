"""Spark-native engine for block-structured ledger data."""
