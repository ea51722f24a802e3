"""Evidence retrieval over pair tables, on Spark."""
