"""Spark-native detection, resolution and de-identification of personal data in text tables."""
