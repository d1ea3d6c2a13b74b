"""Replication of operation streams."""
