"""Stored tables, their files and backups."""
