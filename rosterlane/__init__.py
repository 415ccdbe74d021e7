"""Directory record validation and reconciliation as Spark DataFrame jobs."""
