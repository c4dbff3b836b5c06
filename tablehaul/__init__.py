"""Spark-native data migration and data quality operators."""
