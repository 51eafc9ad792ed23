"""Security posture analytics over typed Spark DataFrames."""
