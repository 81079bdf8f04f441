"""Spark-native analytics over software supply-chain data."""
