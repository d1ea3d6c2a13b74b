"""Reads, writes, recipes, cursors and transactions over keyed data."""
