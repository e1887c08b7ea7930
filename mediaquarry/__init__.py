"""Media-catalog analytics on Spark."""
