"""Ordered, versioned key-value analytics on Spark: operation logs in, visible views out."""
