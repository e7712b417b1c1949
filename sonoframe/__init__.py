"""Spark-native analytics over framed stereo audio."""
