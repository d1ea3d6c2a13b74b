"""Errors of the engine, one class per case."""


class TidelogError(Exception):
    """Base of all errors below."""


class TableExistsError(TidelogError):
    pass


class TableNotFoundError(TidelogError):
    pass


class SpecMismatchError(TidelogError):
    """A table was opened with another schema or key order than it was made with."""


class ReadOnlyTableError(TidelogError):
    pass


class InvalidOptionError(TidelogError):
    pass


class InvalidMergeRangeError(TidelogError):
    pass


class CommitConflictError(TidelogError):
    """Another writer has published a version since this one was read."""


class CorruptTableError(TidelogError):
    """A published file is missing or cannot be read."""


class NotPositionedError(TidelogError):
    """A cursor was read before it stood on a row."""


class TransactionAbortedError(TidelogError):
    pass


class TransactionNotFoundError(TidelogError):
    pass


class TransactionAlreadyCommittedError(TidelogError):
    pass


class BackupBusyError(TidelogError):
    pass
