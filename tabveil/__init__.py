"""Privacy-aware processing of tables and documents on Spark."""
