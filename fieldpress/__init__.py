"""Array-compression analytics on Spark."""
