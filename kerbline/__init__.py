"""Road-crash hotspot analytics as Spark DataFrame jobs."""
