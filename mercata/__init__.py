"""mercata: local supply and demand analytics as Spark DataFrame jobs."""
