"""Spark-native construction, validation, scoring and reporting of labelled tool-call data."""
