"""stowage: archive files as tables on Spark."""
