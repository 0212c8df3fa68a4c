"""A database on disk: Parquet versions of cells and joint cells, and one small file that points at the current one.

Every commit writes a new version folder and then replaces ``meta.json``, so a reader sees the old version or
the new one, and nothing is overwritten while it is read. An ingest writes the counts of its own rows only; a version is
the sum of its parts, and every COMPACT-th commit writes that sum as one part. Writers exclude each other for the moment of the
replacement by a lock file, and one that began from an older version than the current one is refused. Through
Hadoop's file system, so paths may be in any store that Spark reads.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.ingest import added, dim_columns
from .schema import Schema

#: Parts of a version, from which on they are written as one.
COMPACT = 16
#: Of ``meta.json`` and the folders beside it.
FORMAT = 2


class FormatError(ValueError):
    """The database was written by a later release."""


class Conflict(RuntimeError):
    """Another writer was faster, or holds the lock."""


@dataclass
class Meta:
    schema: Schema
    version: str = ""
    batches: dict[str, int] = field(default_factory=dict)  # of each stream, the last batch that is in
    marks: dict[str, str | None] = field(default_factory=dict)  # of each source, the highest value of its order that was read, as text
    raw_log: bool = False
    snapshots: list[tuple[str, float]] = field(default_factory=list)
    seen: dict[str, str] = field(default_factory=dict)  # of each source, where its rows at the mark are listed
    raws: list[str] = field(default_factory=list)  # folders of the raw log
    parts: list[str] = field(default_factory=list)  # folders whose counts add up to the version

    def to_json(self) -> str:
        rest = {k: getattr(self, k) for k in ("version", "batches", "marks", "raw_log", "snapshots", "seen", "raws", "parts")}
        return json.dumps({"format": FORMAT, "schema": json.loads(self.schema.to_json()), **rest})

    @classmethod
    def from_json(cls, text: str) -> Meta:
        raw = json.loads(text)
        if raw.get("format", 1) > FORMAT:
            raise FormatError(f"format {raw['format']} is later than {FORMAT}")
        marks = {k: None if v is None else str(v) for k, v in raw["marks"].items()}
        return cls(Schema.from_json(json.dumps(raw["schema"])), raw["version"], raw["batches"], marks, raw["raw_log"], [tuple(s) for s in raw["snapshots"]], raw.get("seen", {}), raw.get("raws", []), raw.get("parts", [raw["version"]] if raw["version"] else []))

    def copy(self) -> Meta:
        return Meta.from_json(self.to_json())


def table_sum(table: str, *parts: DataFrame) -> DataFrame:
    if len(parts) == 1:
        return parts[0]
    if table != "versions":
        return added(*parts)
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    keys = [f"`{c}`" for c in both.columns if c not in ("version", "last_updated")]
    # a version starts at 1, and each later ingest adds 1
    return both.groupBy(*keys).agg(F.sum("version").alias("version"), F.max("last_updated").alias("last_updated"))


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        where = self._path("")
        self._fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self) -> bool:
        return self._fs.exists(self._path("meta.json"))

    def read_meta(self) -> Meta:
        stream = self._fs.open(self._path("meta.json"))
        try:
            return Meta.from_json(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    @contextmanager
    def _locked(self) -> Iterator[None]:
        lock = self._path("meta.lock")
        self._fs.mkdirs(self._path(""))
        try:
            self._fs.create(lock, False).close()
        except Exception as e:
            raise Conflict(f"another writer holds {lock.toString()}; delete it if there is none") from e
        try:
            yield
        finally:
            self._fs.delete(lock, False)

    def write_meta(self, meta: Meta, after: str | None = None) -> None:
        """``after``: the version that the change began from, if it has to be the current one still."""
        with self._locked():
            if after is not None and self.exists() and self.read_meta().version != after:
                raise Conflict("the database was changed meanwhile")
            self._replace(meta)

    def _replace(self, meta: Meta) -> None:
        """Written aside, then renamed over the old one."""
        aside, real = self._path(f".meta-{uuid.uuid4().hex}"), self._path("meta.json")
        self._fs.mkdirs(self._path(""))
        stream = self._fs.create(aside, True)
        try:
            stream.write(bytearray(meta.to_json().encode()))
        finally:
            stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri() if self._path("").toUri().getScheme() else self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        overwrite = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        overwrite[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(aside, real, overwrite)

    def read(self, meta: Meta, table: str) -> DataFrame | None:
        # with its schema, for a part of no rows has no files, and names of variables may look like numbers
        dims = [(c, "string") for c in dim_columns(meta.schema)]
        columns = {
            "cells": [("variable", "string"), *dims, ("cell", "int"), ("cnt", "bigint")],
            "joint_cells": [("var_a", "string"), ("var_b", "string"), *dims, ("x", "int"), ("y", "int"), ("cnt", "bigint")],
            "versions": [("variable", "string"), *dims, ("version", "bigint"), ("last_updated", "timestamp")],
        }[table]
        kind = ", ".join(f"`{c}` {t}" for c, t in columns)
        parts = [self.spark.read.schema(kind).parquet(f"{self.path}/{p}/{table}").select(*(f"`{c}`" for c, _ in columns)) for p in meta.parts]
        return table_sum(table, *parts) if parts else None

    def commit(self, meta: Meta, cells: DataFrame, joints: DataFrame, versions: DataFrame, raw: DataFrame | None = None, seen: tuple[str, DataFrame] | None = None, add: bool = False) -> None:
        """Write a version and point at it; ``meta`` is changed only by that. ``add``: the tables are added to those that
        are there. Folders of a commit that failed are never read."""
        began, version = meta.version, f"v-{int(time.time() * 1000)}-{uuid.uuid4().hex[:8]}"
        tables = {"cells": cells, "joint_cells": joints, "versions": versions}
        new = meta.copy()
        if add and 0 < len(meta.parts) < COMPACT - 1:
            new.parts.append(version)
        else:
            if add and meta.parts:
                tables = {name: table_sum(name, self.read(meta, name), df) for name, df in tables.items()}
            new.parts = [version]
        for name, df in tables.items():
            writer = df.write.option("compression", "zstd")
            (writer.partitionBy("variable") if name == "cells" else writer).parquet(f"{self.path}/{version}/{name}")
        if raw is not None:
            raw.write.json(f"{self.path}/raw/{version}")
            new.raws.append(f"raw/{version}")
        if seen is not None:
            seen[1].write.option("compression", "zstd").parquet(f"{self.path}/seen/{version}")
            new.seen[seen[0]] = f"seen/{version}"
        new.version = version
        self.write_meta(new, after=began)
        meta.__dict__.update(new.__dict__)

    def read_seen(self, meta: Meta, source: str) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.path}/{meta.seen[source]}") if source in meta.seen else None

    def read_raw(self, meta: Meta) -> DataFrame | None:
        return self.spark.read.json([f"{self.path}/{x}" for x in meta.raws]) if meta.raws else None

    def forget(self, meta: Meta) -> int:
        """Remove the folders that the current version does not read; returns how many. For when no reader uses an older one."""
        found = (x.getPath().getName() for x in self._fs.listStatus(self._path("")))
        old = [x for x in found if x.startswith("v-") and x not in meta.parts and x < meta.version]
        for name in old:
            self._fs.delete(self._path(name), True)
        return len(old)

    def append_snapshot(self, meta: Meta, cells: DataFrame) -> None:
        name = f"snapshots/s-{len(meta.snapshots) + 1:06d}"
        cells.write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        meta.snapshots.append((name, time.time()))

    def read_snapshots(self, meta: Meta) -> DataFrame | None:
        out = None
        for i, (name, taken) in enumerate(meta.snapshots):
            one = self.spark.read.parquet(f"{self.path}/{name}").withColumns({"snapshot": F.lit(i + 1), "taken_at": F.timestamp_seconds(F.lit(taken))})
            out = one if out is None else out.unionByName(one)
        return out
