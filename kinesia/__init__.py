"""Spark-native analytics over keypoints, voice tracks and aligned words."""
