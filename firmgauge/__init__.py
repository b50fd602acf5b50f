"""Spark-native batch analytics over monthly snapshots of companies and their technology footprint."""
