"""Spark-native detection, redaction and page-intent analytics."""
