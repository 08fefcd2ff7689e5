"""pagemill: web-content analytics as PySpark DataFrame jobs."""
