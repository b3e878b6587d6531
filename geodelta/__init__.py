"""Spark-native satellite-navigation observation analytics."""
