"""Spark-native record linkage, reconciliation and audit analytics."""
