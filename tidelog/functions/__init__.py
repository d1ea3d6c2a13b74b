"""Functions that users hand to views and writes: tombstone predicates, expirations, updaters."""

from tidelog.operators.write import expire, slide_expiration
from tidelog.spec import deleted_flag, either, empty_binary, expired, never_deleted, sentinel

__all__ = ["deleted_flag", "either", "empty_binary", "expire", "expired", "never_deleted", "sentinel", "slide_expiration"]
