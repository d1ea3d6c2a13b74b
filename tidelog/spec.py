"""What a keyed table is: its key order, its tombstones, and its options."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.errors import InvalidOptionError

OP, DELETED, LAYER = "__op", "__deleted", "__layer"


#: An expression that is sorted by, and whether ascending; nulls come first if so, else last.
SortKey = tuple[Column, bool]


def precedes(pairs: list[tuple[Column, Column, bool]]) -> Column:
    """Whether the first values ``a`` of ``(a, b, ascending)`` come before the second ones ``b``, compared in turn."""
    out = F.lit(False)
    for a, b, up in reversed(pairs):
        low, high = (a, b) if up else (b, a)
        less = F.coalesce(low < high, low.isNull() & high.isNotNull())
        out = less | (a.eqNullSafe(b) & out)
    return out


@dataclass(frozen=True)
class KeyColumn:
    """One key column: its direction, for strings a collation, for others a compatibility switch.

    ``nan_first`` puts NaN below all numbers; ``longer_first`` puts a byte string before its own prefixes, in either
    direction; ``utf16`` orders strings by UTF-16 code units. By default Spark's orders hold.
    """

    name: str
    ascending: bool = True
    collation: str | None = None
    nan_first: bool = False
    longer_first: bool = False
    utf16: bool = False

    def identity(self) -> Column:
        """Values that are one key under a collation compare equal in this column."""
        c = F.col(self.name)
        return F.collate(c, self.collation) if self.collation else c

    def sort_keys(self, c: Column | None = None) -> list[SortKey]:
        """What a column's values, or those of ``c``, are sorted by, in turn."""
        c = F.col(self.name) if c is None else c
        c = F.collate(c, self.collation) if self.collation else c
        if self.nan_first:
            return [(F.when(c.isNull(), 0).when(F.isnan(c), 1).otherwise(2), self.ascending), (c, self.ascending)]
        if self.longer_first:  # descending, a longer one comes first by itself
            return [(F.concat(F.hex(c), F.lit("~")) if self.ascending else F.hex(c), self.ascending)]
        if self.utf16:
            return [(F.hex(F.encode(c, "UTF-16BE")), self.ascending)]
        return [(c, self.ascending)]

    @property
    def plain(self) -> bool:
        """Whether the key's order is Spark's."""
        return not (self.collation or self.nan_first or self.longer_first or self.utf16)

    def sort_columns(self, reverse: bool = False) -> list[Column]:
        return [c.asc_nulls_first() if up != reverse else c.desc_nulls_last() for c, up in self.sort_keys()]


@dataclass(frozen=True)
class KeySpec:
    """Key columns in sort order; the sequence of columns is the lexicographic order of a composite key."""

    columns: tuple[KeyColumn, ...]

    @classmethod
    def of(cls, *keys: str | KeyColumn) -> KeySpec:
        return cls(tuple(k if isinstance(k, KeyColumn) else KeyColumn(k) for k in keys))

    @property
    def names(self) -> list[str]:
        return [k.name for k in self.columns]

    def group(self) -> list[Column]:
        return [k.identity().alias(k.name) if k.collation else F.col(k.name) for k in self.columns]

    def sort_keys(self) -> list[SortKey]:
        return [s for k in self.columns for s in k.sort_keys()]

    def order(self, reverse: bool = False) -> list[Column]:
        return [c for k in self.columns for c in k.sort_columns(reverse)]

    def compare(self, values: Sequence, *, op: str) -> Column:
        """``key op values`` for ``<, <=, >, >=, ==, !=`` in key order, null keys too. Where the first column's order is Spark's
        own, its bound stands beside it as a plain comparison, which the scan can use."""
        if len(values) > len(self.columns):
            raise ValueError("more values than key columns")
        pairs = []
        for k, v in zip(self.columns, values, strict=False):
            wanted = F.lit(v) if v is not None else F.lit(None).cast("string")
            pairs += [(a, b, up) for (a, up), (b, _) in zip(k.sort_keys(), k.sort_keys(wanted), strict=True)]
        same = F.lit(True)
        for a, b, _ in pairs:
            same = same & a.eqNullSafe(b)
        if op in ("==", "!="):
            return same if op == "==" else ~same
        out = precedes([(b, a, up) for a, b, up in pairs]) if op[0] == ">" else precedes(pairs)
        if op.endswith("="):
            out = out | same
        k, v = self.columns[0], values[0] if values else None
        if k.plain and v is not None:
            c, above = F.col(k.name), (op[0] == ">") == k.ascending
            strict = len(values) == 1 and not op.endswith("=")
            if above:
                out = (c > F.lit(v) if strict else c >= F.lit(v)) & out
            else:
                out = ((c < F.lit(v) if strict else c <= F.lit(v)) | c.isNull()) & out
        return out

    def to_json(self) -> str:
        return json.dumps([asdict(k) for k in self.columns])

    @classmethod
    def from_json(cls, text: str) -> KeySpec:
        return cls(tuple(KeyColumn(**k) for k in json.loads(text)))


#: Decides on the newest record of a key, when it is read, whether the key is there.
IsDeleted = Callable[[DataFrame], Column]


def deleted_flag(df: DataFrame) -> Column:
    """The native tombstone: an explicit column."""
    return F.coalesce(df[DELETED], F.lit(False)) if DELETED in df.columns else F.lit(False)


def never_deleted(df: DataFrame) -> Column:  # noqa: ARG001
    return F.lit(False)


def sentinel(column: str, value: object) -> IsDeleted:
    """Deleted if a value column holds the sentinel; a null sentinel means null."""

    def check(df: DataFrame) -> Column:
        return df[column].isNull() if value is None else F.coalesce(df[column] == F.lit(value), F.lit(False))

    return check


def empty_binary(column: str) -> IsDeleted:
    return lambda df: df[column].isNull() | (F.octet_length(df[column]) == 0)


def expired(column: str, as_of: Column | None = None) -> IsDeleted:
    """Time to live: deleted from its expiration on."""
    return lambda df: F.coalesce(df[column] <= (F.current_timestamp() if as_of is None else as_of), F.lit(False))


def either(*checks: IsDeleted) -> IsDeleted:
    def check(df: DataFrame) -> Column:
        out = F.lit(False)
        for c in checks:
            out = out | c(df)
        return out

    return check


@dataclass(frozen=True)
class Options:
    """Limits of a stored table. ``unsafe`` skips the checks on their ranges."""

    mutable_max: int = 1_000_000
    disk_max: int = 20_000_000
    part_min: int = 1_500_000
    part_max: int = 3_000_000
    merge_threshold: int = 0
    max_sealed: int = 64
    compression: str = "zstd"
    read_only: bool = False
    unsafe: bool = False
    extra: dict = field(default_factory=dict)

    def checked(self) -> Options:
        if self.compression not in ("zstd", "lz4", "gzip", "snappy", "none"):
            raise InvalidOptionError(f"unknown codec {self.compression}")
        if not self.unsafe:
            for ok, what in (
                (self.mutable_max >= 1000, "mutable_max is at least 1000"),
                (self.disk_max >= 10_000, "disk_max is at least 10000"),
                (0 < self.part_min < self.part_max, "part_min is below part_max"),
                (self.merge_threshold >= 0, "merge_threshold is not negative"),
                (self.max_sealed >= 1, "max_sealed is at least 1"),
            ):
                if not ok:
                    raise InvalidOptionError(what)
        return self

    def clone(self, **changes: object) -> Options:
        return replace(self, **changes)
