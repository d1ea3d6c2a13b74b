"""Stored keyed tables: immutable Parquet segments in layers, under versioned manifests.

A table's folder holds ``data/<segment>`` and ``manifest/v<n>.json``. A version lists the layers, newest first: the open
delta, sealed deltas, the disk slot, bottom segments. Publishing a version is one rename that only one writer can win; files
of no published version are invisible. Readers pin a version by number. Rows carry their operation index and tombstone flag.
"""

from __future__ import annotations

import json
import uuid
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.errors import (
    CommitConflictError,
    CorruptTableError,
    InvalidMergeRangeError,
    ReadOnlyTableError,
    SpecMismatchError,
    TableExistsError,
    TableNotFoundError,
)
from tidelog.operators.ranks import Cuts
from tidelog.operators.read import BROADCAST_KEYS, only_keys
from tidelog.operators.write import assign_ops, compact_log
from tidelog.plans.view import last_write_wins, layered, layered_in_ranges, of_layers, visible
from tidelog.sources.files import Files
from tidelog.spec import DELETED, LAYER, OP, IsDeleted, KeySpec, Options, deleted_flag

#: Names the folders in which a segment keeps the files that go between those carried over.
GAP = "__gap"
#: Parts of a rewrite that get a file each; of more, so many share a file and a task takes so many records. Rows of a delta's file.
FILES, PER_FILE, TASK_ROWS, DELTA_ROWS = 200, 256, 50_000, 3_000_000
MERGE_RESULTS = ("success", "nothing_to_merge", "cancelled_by_user", "failure", "another_merge_running", "range_invalid")


def merge_layers(log: DataFrame, key: KeySpec, layers: list[int], *, older_remain: bool, is_deleted: IsDeleted = deleted_flag, in_ranges: bool = False) -> DataFrame:
    """Newest layer's record of each key; tombstones are kept exactly if older layers remain that they must hide."""
    merged = (layered_in_ranges if in_ranges else layered)(of_layers(log, layers), key)
    return merged if older_remain else merged.where(~is_deleted(merged))


@dataclass
class Part:
    """What a merge rewrites or carries: a file of a segment, or rows of it from ``start`` on; its rows and tombstones, and the range
    of the first key column where that has a plain order. ``of``: rows that the file was written with."""

    path: str
    rows: int
    low: object = None
    high: object = None
    tombstones: int = 0
    start: int = 0
    of: int = 0

    def takes(self, other: Part) -> None:
        """Grow by the part that follows in the file."""
        self.rows, self.tombstones = self.rows + other.rows, self.tombstones + other.tombstones
        self.low = min((x for x in (self.low, other.low) if x is not None), default=None)
        self.high = max((x for x in (self.high, other.high) if x is not None), default=None)

    def overlaps(self, low: object, high: object) -> bool:
        if None in (self.low, self.high, low, high):
            return True
        return self.low <= high and low <= self.high


@dataclass
class Segment:
    id: str
    parts: list[Part] = field(default_factory=list)

    @property
    def tombstones(self) -> int:
        return sum(p.tombstones for p in self.parts)

    @property
    def rows(self) -> int:
        return sum(p.rows for p in self.parts)


def _apart(parts: list[tuple[int, Part]]) -> list[Part]:
    """Of parts with their segments, those that have a range and overlap none of another segment: one sort, then each is sought."""
    bare = {i for i, p in parts if p.low is None}
    ranged = sorted(((p.low, i, p.high) for i, p in parts if p.low is not None), key=lambda x: x[0])
    lows, tops = [low for low, _, _ in ranged], []
    first = second = None  # the highest ends so far, of two segments
    for _, i, high in ranged:
        if first is None or first[1] == i or high > first[0]:
            second = first if first is not None and first[1] != i else second
            first = (high, i) if first is None or high > first[0] else first
        elif second is None or high > second[0]:
            second = (high, i)
        tops.append((first, second))
    out = []
    for i, p in parts:
        if p.low is None or bare - {i}:
            continue
        top, next_top = tops[bisect_right(lows, p.high) - 1]
        other = next_top if top[1] == i else top
        if other is None or other[0] < p.low:
            out.append(p)
    return out


def _not_worn(parts: list[Part]) -> list[Part]:
    """Parts to carry, without those of files of which less than half would be left: these are rewritten."""
    left = Counter()
    for p in parts:
        left[p.path] += p.rows
    return [p for p in parts if 2 * left[p.path] >= p.of]


@dataclass
class Manifest:
    version: int
    key: str
    schema: str
    options: dict
    max_op: int = 0
    open: list[Segment] = field(default_factory=list)  # newest first, as all of these
    sealed: list[Segment] = field(default_factory=list)
    disk: Segment | None = None
    bottom: list[Segment] = field(default_factory=list)

    def layers(self) -> list[tuple[str, Segment]]:
        out = [("open", s) for s in self.open] + [("sealed", s) for s in self.sealed]
        return out + ([("disk", self.disk)] if self.disk else []) + [("bottom", s) for s in self.bottom]

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Manifest:
        d = json.loads(text)
        seg = lambda s: Segment(s["id"], [Part(**p) for p in s["parts"]])
        return cls(**{**d, "open": [*map(seg, d["open"])], "sealed": [*map(seg, d["sealed"])], "disk": seg(d["disk"]) if d["disk"] else None, "bottom": [*map(seg, d["bottom"])]})


class KeyedTable:
    """One ordered map from keys to rows."""

    def __init__(self, spark: SparkSession, path: str, key: KeySpec, schema: T.StructType, options: Options, *, is_deleted: IsDeleted = deleted_flag) -> None:
        self.spark, self.path, self.key, self.schema, self.options, self.is_deleted = spark, path.rstrip("/"), key, schema, options, is_deleted
        self.files = Files(spark, path)
        self.listeners: list[Callable[[str, dict], None]] = []
        self._merging = self._cancelled = False

    # -- open and create

    @classmethod
    def create(cls, spark: SparkSession, path: str, key: KeySpec, schema: T.StructType, options: Options | None = None, **more: object) -> KeyedTable:
        table = cls(spark, path, key, schema, (options or Options()).checked(), **more)
        if table.files.names(f"{table.path}/manifest"):
            raise TableExistsError(path)
        table.files.write_new(table._file(0), Manifest(0, key.to_json(), schema.json(), asdict(table.options)).to_json())
        return table

    @classmethod
    def open(cls, spark: SparkSession, path: str, key: KeySpec | None = None, schema: T.StructType | None = None, options: Options | None = None, **more: object) -> KeyedTable:
        files = Files(spark, path)
        names = [n for n in files.names(f"{path.rstrip('/')}/manifest") if n.endswith(".json")]
        if not names:
            raise TableNotFoundError(path)
        stored = Manifest.from_json(files.read(f"{path.rstrip('/')}/manifest/{max(names)}"))
        if key is not None and key.to_json() != stored.key:
            raise SpecMismatchError(f"key order is {stored.key}")
        if schema is not None and schema.json() != stored.schema:
            raise SpecMismatchError(f"schema is {stored.schema}")
        return cls(spark, path, KeySpec.from_json(stored.key), T.StructType.fromJson(json.loads(stored.schema)), (options or Options(**stored.options)).checked(), **more)

    @classmethod
    def open_or_create(cls, spark: SparkSession, path: str, key: KeySpec, schema: T.StructType, options: Options | None = None, **more: object) -> KeyedTable:
        try:
            return cls.open(spark, path, key, schema, options, **more)
        except TableNotFoundError:
            return cls.create(spark, path, key, schema, options, **more)

    def drop(self) -> None:
        self._writable()
        self.files.delete(self.path)

    # -- versions

    def _file(self, version: int) -> str:
        return f"{self.path}/manifest/v{version:012d}.json"

    def versions(self) -> list[int]:
        return [int(n[1:-5]) for n in self.files.names(f"{self.path}/manifest") if n.endswith(".json")]

    def manifest(self, version: int | None = None) -> Manifest:
        versions = self.versions()
        if not versions or version is not None and version not in versions:
            raise TableNotFoundError(f"{self.path}, version {version}")
        return Manifest.from_json(self.files.read(self._file(versions[-1] if version is None else version)))

    def _publish(self, m: Manifest) -> Manifest:
        """Publish on top of the version that ``m`` was read from; fails if another one has come in between."""
        self._writable()
        m.version += 1
        if self.files.exists(self._file(m.version)):
            raise CommitConflictError(self._file(m.version))
        self.files.write_new(self._file(m.version), m.to_json())
        return m

    def _writable(self) -> None:
        if self.options.read_only:
            raise ReadOnlyTableError(self.path)

    def _tell(self, event: str, **what: object) -> None:
        for f in self.listeners:
            f(event, what)

    # -- segments

    def _write(self, rows: DataFrame, *, around: list[Part] | None = None, per_file: int = 0) -> Segment:
        """Write a segment, each file sorted by key, so that row groups can be skipped. A delta (``per_file`` 0) has a part a file. Other
        parts have ``part_max`` rows at most and lie up to ``per_file`` in a file. No part reaches over one of ``around``."""
        segment = Segment(uuid.uuid4().hex)
        path = f"{self.path}/data/{segment.id}"
        codec = {"none": "uncompressed"}.get(self.options.compression, self.options.compression)
        own, rows, most = self._ranged_by(), rows.select(*self._columns()), self.options.part_max
        lows = sorted(p.low for p in around or [] if p.low is not None)
        gaps = Cuts.of(lows, T.StringType() if isinstance(lows[0], str) else T.LongType()) if lows else None
        gap = [GAP] if gaps and per_file == 1 else []
        if gap:
            rows = gaps.numbered(rows, [(own, True)], GAP)
        writer = rows.sortWithinPartitions(*gap, *self.key.order()).write.option("compression", codec).option("maxRecordsPerFile", most * per_file or max(most, DELTA_ROWS))
        (writer.partitionBy(*gap) if gap else writer).parquet(path)
        place = F.col("_metadata.row_index")
        aggs = [F.count("*").alias("n"), F.sum(F.col(DELETED).cast("long")).alias("t"), F.max(OP).alias("top"), F.min(place).alias("start"), *((F.min(own).alias("low"), F.max(own).alias("high")) if own is not None else ())]
        self._top = 0
        written = self.spark.read.schema(self._stored()).option("recursiveFileLookup", "true").parquet(path)
        by = [F.col("_metadata.file_path").alias("file")]
        if per_file > 1:
            by += [F.floor(place / most).alias("block"), F.col(GAP).alias("gap") if gaps else F.lit(0).alias("gap")]
            if gaps:
                written = gaps.numbered(written.select("*", "_metadata"), [(own, True)], GAP)
        last = None
        for r in sorted(written.groupBy(*by).agg(*aggs).collect(), key=lambda r: (r["file"], r["start"])):  # a row per part
            name = f"data/{segment.id}/{r['file'].split(f'/data/{segment.id}/', 1)[1]}".replace("%3D", "=")
            part = Part(name, r["n"], *((r["low"], r["high"]) if own is not None else (None, None)), r["t"] or 0, r["start"])
            self._top = max(self._top, r["top"] or 0)
            if per_file > 1 and last == (name, r["gap"]) and segment.parts[-1].rows + part.rows <= most:
                segment.parts[-1].takes(part)
            else:
                segment.parts.append(part)
            last = (name, r["gap"]) if per_file > 1 else None
        sizes = Counter()
        for p in segment.parts:
            sizes[p.path] += p.rows
        for p in segment.parts:
            p.of = sizes[p.path]
        return segment

    def _ranged_by(self) -> Column | None:
        """The first key column as a number or string of the same order; None if it has none."""
        first = self.key.columns[0]
        kind, c = self._type(first.name), F.col(first.name)
        if not first.plain:
            return None
        if isinstance(kind, T.IntegralType):
            return c.cast("long")
        if isinstance(kind, T.StringType):
            return c
        if isinstance(kind, T.DateType):
            return F.unix_date(c)
        return F.unix_micros(c) if isinstance(kind, T.TimestampType) else None

    def _spread(self, log: DataFrame, rows: int) -> tuple[DataFrame, int]:
        """A log of at most ``rows`` records in ranges of keys, and the parts that a file gets. There is a range for each file to come, of
        ``part_min`` rows if none are dropped; where these are many and small, a range has many parts. The shuffle serves the merge,
        too: a key's records meet in one range."""
        ranges, per_file = max(1, -(-rows // self.options.part_min)), 1
        if ranges > FILES and (per_file := max(1, min(PER_FILE, TASK_ROWS // self.options.part_max))) > 1:
            ranges = -(-rows // TASK_ROWS)
        return log.repartitionByRange(ranges, *self.key.order()), per_file

    def _touched(self, old: list[Part], delta: list[Part]) -> list[Part]:
        """Parts of ``old`` in whose range some record of ``delta`` lies, or that have no range. At most a number per part comes
        to the driver."""
        own = self._ranged_by()
        ends = [x for d in delta for x in (d.low, d.high)]
        low, high = (None, None) if None in ends or not ends else (min(ends), max(ends))
        near = sorted((p for p in old if p.low is not None and p.overlaps(low, high)), key=lambda p: (p.low, p.high))
        bare = [p for p in old if p.low is None]
        if own is None or not near:
            return bare + near
        keys = self._read(delta).select(own.alias("k")).distinct()
        order = [(F.col("k"), True)]
        # per number of parts that begin at or before a key, the least key
        least = Cuts.of([p.low for p in near], keys.schema["k"].dataType).numbered(keys, order, "stop").groupBy("stop").agg(F.min("k").alias("k"), F.max(F.col("k").isNull()).alias("null")).collect()
        tops = list(accumulate((p.high for p in near), max))
        hit: set[int] = set()
        for r in least:
            i = r["stop"] - 1
            while i >= 0 and r["k"] is not None and tops[i] >= r["k"]:
                if near[i].high >= r["k"]:
                    hit.add(i)
                i -= 1
            if r["null"]:  # null keys lie at one end
                hit |= {0, len(near) - 1}
        return bare + [near[i] for i in sorted(hit)]

    def _type(self, name: str) -> T.DataType:
        return self.schema[name].dataType

    def _columns(self) -> list[str]:
        return [*self.schema.names, OP, DELETED]

    def _stored(self) -> T.StructType:
        return T.StructType([*self.schema.fields, T.StructField(OP, T.LongType()), T.StructField(DELETED, T.BooleanType())])

    def _read(self, parts: list[Part]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self._stored())
        files: dict[str, list[Part]] = {}
        for p in parts:
            files.setdefault(p.path, []).append(p)
        there = {folder: set(self.files.names(f"{self.path}/{folder}")) for folder in {f.rsplit("/", 1)[0] for f in files}}
        for f in files:
            folder, name = f.rsplit("/", 1)
            if name not in there[folder]:
                raise CorruptTableError(f"{f} is missing")
        partly = {f: own for f, own in files.items() if sum(p.rows for p in own) < own[0].of}
        whole = [f for f in files if f not in partly]
        if not partly:
            return self._files(whole)
        runs = []  # rows that count, by file
        for f, own in partly.items():
            run: list[list[int]] = []
            for p in sorted(own, key=lambda p: p.start):
                if run and run[-1][1] == p.start:
                    run[-1][1] += p.rows
                else:
                    run.append([p.start, p.start + p.rows])
            runs.append((f, run))
        wanted = self.spark.createDataFrame(runs, "__path string, __runs array<array<bigint>>")
        rows = self._files([*partly]).select("*", F.substring_index("_metadata.file_path", "/", -3).alias("__path"), F.col("_metadata.row_index").alias("__row"))
        inside = F.exists("__runs", lambda x: (F.col("__row") >= x[0]) & (F.col("__row") < x[1]))
        rows = rows.join(F.broadcast(wanted), "__path").where(inside).select(*self._columns())  # a row per file
        return self._files(whole).unionByName(rows) if whole else rows

    def _files(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self._stored()).option("recursiveFileLookup", "true").parquet(*(f"{self.path}/{p}" for p in paths))

    def log(self, version: int | None = None, *, kinds: tuple[str, ...] = ("open", "sealed", "disk", "bottom"), low: object = None, high: object = None) -> DataFrame:
        """All records of a version with their layer, 0 the newest. Files outside ``[low, high]`` of the first key column are left out."""
        out = None
        for i, (kind, s) in enumerate(self.manifest(version).layers()):
            parts = [p for p in s.parts if low is None and high is None or p.overlaps(low if low is not None else p.low, high if high is not None else p.high)]
            if kind in kinds and parts:
                rows = self._read(parts).withColumn(LAYER, F.lit(i))
                out = rows if out is None else out.unionByName(rows)
        return out if out is not None else self._read([]).withColumn(LAYER, F.lit(0))

    def view(self, version: int | None = None, *, include_deleted: bool = False, **what: object) -> DataFrame:
        """What a reader of a version sees. The disk slot has each key once, so it is not aggregated: what newer layers hold takes
        its records' places."""
        m = self.manifest(version)
        base = self.log(version, **(what | {"kinds": ("disk",)})) if m.disk and not m.bottom and "kinds" not in what and not any(k.collation for k in self.key.columns) else None
        if base is None:
            return visible(self.log(version, **what), self.key, is_deleted=self.is_deleted, by_layer=True, include_deleted=include_deleted).drop(LAYER)
        newer = m.open + m.sealed
        if newer:
            top = layered(self.log(version, **(what | {"kinds": ("open", "sealed")})), self.key)
            keys = top.select(*self.key.names)
            if sum(s.rows for s in newer) <= BROADCAST_KEYS:
                keys = F.broadcast(keys)
            base = base.join(keys, [base[k].eqNullSafe(keys[k]) for k in self.key.names], "left_anti").unionByName(top)
        return (base if include_deleted else base.where(~self.is_deleted(base))).drop(LAYER)

    def get(self, keys: DataFrame, version: int | None = None) -> DataFrame:
        """What a reader sees of some keys: only their records are aggregated."""
        log = only_keys(self.log(version), keys, self.key)
        return visible(log, self.key, is_deleted=self.is_deleted, by_layer=True).drop(LAYER)

    def snapshot(self) -> int:
        """Seal, and the version to read from then on: later writes do not show in it."""
        self.seal()
        return self.manifest().version

    def read_only_region(self, version: int | None = None) -> DataFrame:
        return self.view(version, kinds=("sealed", "disk", "bottom"))

    def in_memory_region(self, version: int | None = None) -> DataFrame:
        return self.view(version, kinds=("open", "sealed"), include_deleted=True)

    # -- writes

    def append(self, rows: DataFrame, *order: Column | str, keep_ops: bool = False) -> int:
        """Append records as one atomic batch; returns how many. Operation indexes go on from the table's, dense, in ``order`` or,
        without one, as the rows come; or they are those that the rows bring. Retried by the caller on a conflict."""
        self._writable()
        m = self.manifest()
        if DELETED not in rows.columns:
            rows = rows.withColumn(DELETED, F.lit(False))
        for f in self.schema.fields:
            if f.name not in rows.columns:
                rows = rows.withColumn(f.name, F.lit(None).cast(f.dataType))
        staged = None
        if not keep_ops and order:
            rows = assign_ops(rows, m.max_op + 1, *order)
        elif not keep_ops:
            staged = f"{self.path}/data/{uuid.uuid4().hex}"
            rows = self._as_they_come(rows, m.max_op + 1, staged)
        segment = self._write(rows)
        if staged:
            self.files.delete(staged)
        if not segment.rows:
            return 0
        m.open.insert(0, segment)
        m.max_op = max(m.max_op, self._top)
        self._publish(m)
        if sum(s.rows for s in m.open) >= self.options.mutable_max:
            self.seal()
        return segment.rows

    def _as_they_come(self, rows: DataFrame, start: int, path: str) -> DataFrame:
        """Rows with dense operation indexes: written once with their task and place in it, then each task's rows are counted."""
        rows = rows.select(*self.schema.names, F.col(DELETED), F.monotonically_increasing_id().alias(OP))
        rows.write.option("compression", "snappy").parquet(path)
        written = self.spark.read.schema(self._stored()).parquet(path)
        task, place = F.shiftright(OP, 33), F.col(OP).bitwiseAND((1 << 33) - 1)
        sizes = {r["task"]: r["n"] for r in written.groupBy(task.alias("task")).agg(F.count("*").alias("n")).collect()}  # a row per task
        before, total = [], start
        for i in range(max(sizes, default=-1) + 1):
            before.append(total)
            total += sizes.get(i, 0)
        table = F.from_json(F.lit(json.dumps(before)), "array<bigint>")
        return written.withColumn(OP, F.get(table, task.cast("int")) + place)

    def delete(self, keys: DataFrame, *, force: bool = False) -> int:
        """Tombstones for keys that are there, or for all of them."""
        keys = keys.select(*self.key.names).distinct()
        if not force:
            keys = keys.join(self.get(keys).select(*self.key.names), self.key.names, "left_semi")
        return self.append(keys.withColumn(DELETED, F.lit(True)))

    # -- maintenance

    def seal(self) -> bool:
        """Close the open delta; nothing happens if it is empty. Several batches become one layer, their newest records."""
        m = self.manifest()
        if not m.open:
            return False
        if len(m.open) > 1:
            rows = self._read([p for s in m.open for p in s.parts])
            sealed = self._write(compact_log(rows, self.key))
        else:
            sealed = m.open[0]
        m.open, m.sealed = [], [sealed, *m.sealed]
        self._publish(m)
        self._tell("segment_sealed", id=sealed.id)
        return True

    def merge(self) -> str:
        """Merge sealed layers and the disk slot into a new disk slot, without touching parts that no sealed record overlaps, but for
        those left in files of which most is gone.

        Tombstones go unless bottom segments remain. A new slot above ``disk_max`` rows moves to the bottom, whole.
        """
        if self._merging:
            return "another_merge_running"
        m = self.manifest()
        if not m.sealed:
            return "nothing_to_merge"
        self._merging, self._cancelled = True, False
        self._tell("merge_started")
        result = "failure"
        try:
            delta = [p for s in m.sealed for p in s.parts]
            old = m.disk.parts if m.disk else []
            hit = {id(p) for p in self._touched(old, delta)}
            if not m.bottom:  # tombstones that hide nothing go
                hit |= {id(p) for p in old if p.tombstones}
            clean = _not_worn([p for p in old if id(p) not in hit])
            carried = {id(p) for p in clean}
            touched = [p for p in old if id(p) not in carried]
            log = self._read(touched).withColumn(LAYER, F.lit(len(m.sealed)))
            for i, s in enumerate(m.sealed):
                log = log.unionByName(self._read(s.parts).withColumn(LAYER, F.lit(i)))
            log, per_file = self._spread(log, sum(p.rows for p in (*touched, *delta)))
            merged = merge_layers(log, self.key, list(range(len(m.sealed) + 1)), older_remain=bool(m.bottom), is_deleted=self.is_deleted, in_ranges=True)
            new = self._write(merged.drop(LAYER), around=clean, per_file=per_file)
            new.parts = sorted([*clean, *new.parts], key=lambda p: (p.low is not None, p.low))
            if self._cancelled:
                result = "cancelled_by_user"
                return result
            now = self.manifest()
            n = len(m.sealed)
            if [s.id for s in now.sealed[-n:]] != [s.id for s in m.sealed] or (now.disk and now.disk.id) != (m.disk and m.disk.id):
                return result
            now.sealed, now.disk = now.sealed[:-n], new if new.rows else None
            if now.disk and now.disk.rows > self.options.disk_max:
                now.bottom, now.disk = [now.disk, *now.bottom], None
            self._publish(now)
            self._tell("disk_segment_activated", id=new.id)
            result = "success"
            return result
        finally:
            self._merging = False
            self._tell("merge_ended", result=result)

    def merge_bottom(self, start: int, stop: int) -> str:
        """Merge bottom segments ``start..stop``, both ends in, 0 the newest; tombstones stay if older segments do.

        Published only if the same segments still stand in a row.
        """
        m = self.manifest()
        stop = min(stop, len(m.bottom) - 1)
        if start < 0 or start >= stop:
            raise InvalidMergeRangeError(f"{start}..{stop} of {len(m.bottom)}")
        chosen = m.bottom[start : stop + 1]
        older = stop < len(m.bottom) - 1
        all_parts = [(i, p) for i, s in enumerate(chosen) for p in s.parts]
        # a part that no other chosen segment's parts overlap needs no rewriting, if its tombstones may stay
        apart = _apart(all_parts) if self.is_deleted is deleted_flag else []
        clean = _not_worn([p for p in apart if older or not p.tombstones])
        carried = {id(p) for p in clean}
        rest = [(i, p) for i, p in all_parts if id(p) not in carried]
        log = self._read([]).withColumn(LAYER, F.lit(0))
        for i in range(len(chosen)):
            own = [p for j, p in rest if j == i]
            log = log.unionByName(self._read(own).withColumn(LAYER, F.lit(i))) if own else log
        log, per_file = self._spread(log, sum(p.rows for _, p in rest))
        merged = merge_layers(log, self.key, list(range(len(chosen))), older_remain=older, is_deleted=self.is_deleted, in_ranges=True)
        new = self._write(merged.drop(LAYER), around=clean, per_file=per_file)
        new.parts = sorted([*clean, *new.parts], key=lambda p: (p.low is not None, p.low))
        if self._cancelled:
            self._cancelled = False
            return "cancelled_by_user"
        now = self.manifest()
        ids, wanted = [s.id for s in now.bottom], [s.id for s in chosen]
        at = next((i for i in range(len(ids)) if ids[i : i + len(wanted)] == wanted), None)
        if at is None:
            return "failure"
        now.bottom[at : at + len(wanted)] = [new] if new.rows else []
        self._publish(now)
        return "success"

    def cancel_merge(self) -> None:
        self._cancelled = True

    def evict(self) -> str:
        self.seal()
        return self.merge()

    def maintain(self) -> str:
        """Merge if there are many sealed layers, or enough sealed records."""
        m = self.manifest()
        if m.sealed and (len(m.sealed) > self.options.max_sealed or sum(s.rows for s in m.sealed) > self.options.merge_threshold):
            return self.merge()
        return "nothing_to_merge"

    def collect_garbage(self) -> bool:
        """Compact a table that consists of open deltas alone: newest records, no tombstones, operation indexes as they were."""
        m = self.manifest()
        if not m.open or m.sealed or m.disk or m.bottom:
            return False
        rows = self._read([p for s in m.open for p in s.parts])
        new = self._write(compact_log(rows, self.key, is_deleted=self.is_deleted, keep_tombstones=False))
        m.open = [new] if new.rows else []
        self._publish(m)
        return True

    def vacuum(self, keep: int = 1) -> int:
        """Forget all but the newest ``keep`` versions and delete the segments that none of the rest uses."""
        self._writable()
        versions = self.versions()
        kept = versions[-max(1, keep) :]
        used = {p.path.split("/")[1] for v in kept for _, s in self.manifest(v).layers() for p in s.parts}
        for v in versions[: -len(kept)]:
            self.files.delete(self._file(v))
        gone = [n for n in self.files.names(f"{self.path}/data") if n not in used]
        for n in gone:
            self.files.delete(f"{self.path}/data/{n}")
        return len(gone)

    def save_metadata(self) -> int:
        return self._publish(self.manifest()).version

    # -- figures

    def count(self) -> int:
        """Visible keys. With one tombstone-free base and no bottom segments only the delta is read."""
        m = self.manifest()
        if m.bottom or m.disk and m.disk.tombstones or self.is_deleted is not deleted_flag or not m.disk:
            return self.view().count()
        delta = last_write_wins(self.log(kinds=("open", "sealed")), self.key, rank=[-F.col(LAYER)])
        base = self.log(kinds=("disk",)).select(*self.key.names).withColumn("__in", F.lit(True))
        change = F.when(F.col(DELETED) & F.col("__in"), -1).when(~F.col(DELETED) & F.col("__in").isNull(), 1).otherwise(0)
        return m.disk.rows + (delta.join(base, self.key.names, "left").agg(F.sum(change)).first()[0] or 0)

    def record_counts(self) -> dict[str, int]:
        m = self.manifest()
        out = {"open": sum(s.rows for s in m.open), "sealed": sum(s.rows for s in m.sealed), "disk": m.disk.rows if m.disk else 0, "bottom": sum(s.rows for s in m.bottom)}
        return out | {"sealed_segments": len(m.sealed), "in_memory": out["open"] + out["sealed"], "total": sum(out.values())}
