"""Views of operation logs as logical plans."""
