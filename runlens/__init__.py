"""runlens: run-evidence analytics as Spark DataFrame jobs."""
