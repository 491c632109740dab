"""lattica: topological feature analytics as Spark DataFrame jobs."""
