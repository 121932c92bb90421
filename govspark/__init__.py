"""Data-governance analytics on Spark tables and streams."""
