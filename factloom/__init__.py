"""Spark-first engine that turns scattered operational records into source-backed facts."""
