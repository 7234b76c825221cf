"""lorespark: content-knowledge analytics as Spark jobs."""
