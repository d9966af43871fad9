"""Engineering-activity analytics on Spark."""
