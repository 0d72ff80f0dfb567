"""Spark-native construction, curation and scoring of "broken -> fixed" configuration datasets."""
