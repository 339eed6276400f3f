"""Spark-native analytics for sampled frames, detections, scores and their vectors."""
