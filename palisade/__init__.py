"""Request-log security analytics as ordinary Spark jobs."""
