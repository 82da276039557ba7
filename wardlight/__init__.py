"""Security-log detection, correlation and ranking as Spark jobs."""
