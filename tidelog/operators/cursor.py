"""A cursor over a visible view, for callers that read row by row in key order; bulk reads should stay DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, Row

from tidelog.errors import NotPositionedError
from tidelog.operators import read
from tidelog.spec import KeySpec


class Cursor:
    """Stands before its first row until ``next``. ``refresh`` plans anew from ``source`` and goes on behind the last key read."""

    def __init__(self, source: Callable[[], DataFrame], key: KeySpec, *, reverse: bool = False) -> None:
        self.source, self.key, self.reverse = source, key, reverse
        self.row: Row | None = None
        self.last: list | None = None
        self._rows: Iterator[Row] | None = None

    def _start(self, df: DataFrame) -> None:
        self._rows, self.row = df.toLocalIterator(), None

    def seek(self, values: Sequence) -> None:
        self._start(read.seek(self.source(), self.key, values, reverse=self.reverse))

    def seek_first(self) -> None:
        self._start(read.scan(self.source(), self.key, reverse=self.reverse))

    def next(self) -> bool:
        if self._rows is None:
            self.seek_first()
        self.row = next(self._rows, None)
        if self.row is not None:
            self.last = [self.row[k] for k in self.key.names]
        return self.row is not None

    def refresh(self) -> None:
        if self.last is None:
            self.seek_first()
        else:
            self._start(read.after(self.source(), self.key, self.last, reverse=self.reverse))

    @property
    def has_current(self) -> bool:
        return self.row is not None

    @property
    def current(self) -> Row:
        if self.row is None:
            raise NotPositionedError("call next() first")
        return self.row

    def current_key(self) -> list:
        return [self.current[k] for k in self.key.names]
