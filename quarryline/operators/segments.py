"""Tables as segments: a version writes what it changes, and readers merge.

A table's version is a list of segments, oldest first.  A segment holds rows and the keys
that it replaces or removes: rows of older segments with such a key are gone.  A commit
writes one new segment for each table that changes, so what is written goes with the change.
When the newest segments have grown to the size of those before them, they are merged, so
a table of n rows has about log n segments and a row is written again about log n times.

A manifest names the segments of all tables of a version and is written before the pointer
to it; readers that opened an older version go on reading its files until ``collect`` lets
those go.  Manifests are as long as there are segments, so they may be read by the driver.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from quarryline.storage import remove_folder

_MANIFEST = "table string, place int, segment string, n_rows bigint, gone_in string, n_gone bigint"


@dataclass(frozen=True)
class Layout:
    """Key columns of a table, and the order of the rows in its files."""

    schema: str | StructType
    key: tuple[str, ...]
    order: tuple[str, ...] = ()


@dataclass(frozen=True)
class Change:
    """Rows to add and the keys (a table with the key columns) whose older rows go."""

    rows: DataFrame
    gone: DataFrame


@dataclass(frozen=True)
class Segment:
    """A segment's folder and the folder of its keys, which several tables may share."""

    table: str
    segment: str
    n_rows: int
    gone_in: str
    n_gone: int


def merged(parts: list[Change], key: tuple[str, ...]) -> DataFrame:
    """The rows in force of segments, oldest first."""
    out, gone = [], None
    for part in reversed(parts):
        out.append(part.rows if gone is None else part.rows.join(gone, list(key), "left_anti"))
        gone = part.gone if gone is None else gone.unionByName(part.gone)
    return reduce(DataFrame.unionByName, reversed(out))


def first_to_merge(sizes: list[int]) -> int:
    """Index of the first of the newest segments to be merged: while the one before is no larger than twice those after it."""
    first, total = len(sizes) - 1, sizes[-1]
    while first > 0 and sizes[first - 1] <= 2 * total:
        first -= 1
        total += sizes[first]
    return first


class Store:
    """Versions of tables below a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, base: str, layouts: dict[str, Layout]):
        self.spark, self.base, self.layouts = spark, base.rstrip("/"), layouts

    def versions(self) -> list[str]:
        """Names of the published versions, oldest first."""
        path = f"{self.base}/current"
        if not self._exists(path):
            return []
        return [r["version"] for r in self.spark.read.parquet(path).orderBy("no").collect()]

    def manifest(self, version: str | None = None) -> dict[str, list[Segment]]:
        """Segments of each table, of the newest version unless one is named."""
        version = version or next(reversed(self.versions()), None)
        found: dict[str, list[Segment]] = {t: [] for t in self.layouts}
        if version is not None:
            for r in self.spark.read.schema(_MANIFEST).parquet(f"{self.base}/manifests/{version}").orderBy("place").collect():
                found[r["table"]].append(Segment(r["table"], r["segment"], r["n_rows"], r["gone_in"], r["n_gone"]))
        return found

    def tables(self, version: str | None = None) -> dict[str, DataFrame]:
        return {t: self._table(t, segments) for t, segments in self.manifest(version).items()}

    def commit(self, changes: dict[str, Change], based_on: str | None = None) -> str:
        """Writes a version with these changes and makes it the newest; returns its name.

        ``based_on`` is the version the changes were reckoned from; if another has come
        in between, nothing is published.
        """
        versions = self.versions()
        newest = versions[-1] if versions else None
        if based_on is not None and based_on != newest:
            raise ValueError(f"version {newest} was published meanwhile; nothing was published")
        held, shared = self.manifest(newest), {}
        for table, change in changes.items():  # tables with the same keys share them
            shared.setdefault((id(change.gone), self.layouts[table].key), change.gone)
        with ThreadPoolExecutor(8) as pool:  # the tables' jobs run side by side
            keys = dict(zip(shared, pool.map(lambda k: self._keys(shared[k], k[1]), shared)))
            place = {t: keys[id(c.gone), self.layouts[t].key] for t, c in changes.items()}
            written = list(pool.map(lambda t: self._written(t, changes[t].rows, *place[t]), changes))
            fresh = [w for w in written if w.n_rows or w.n_gone]
            settled = pool.map(lambda w: self._settled(w.table, [*held[w.table], w]), fresh)
            held |= dict(zip((w.table for w in fresh), settled))
        name = uuid.uuid4().hex
        rows = [(t, i, s.segment, s.n_rows, s.gone_in, s.n_gone) for t, segments in held.items() for i, s in enumerate(segments)]
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.parquet(f"{self.base}/manifests/{name}")
        pointer = self.spark.createDataFrame([(name, len(versions))], "version string, no bigint")
        pointer.coalesce(1).write.mode("append").parquet(f"{self.base}/current")
        return name

    def collect(self, keep: int = 2) -> list[str]:
        """Deletes segments that none of the newest ``keep`` versions has; returns their names.

        A reader of an older version must be done by then.
        """
        versions = self.versions()
        used = {f for v in versions[-keep:] for segments in self.manifest(v).values() for s in segments for f in (s.segment, s.gone_in)}
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.base}/data")
        system = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        there = [s.getPath().getName() for s in system.listStatus(folder)] if system.exists(folder) else []
        old = [name for name in there if name not in used]
        for name in old:
            remove_folder(self.spark, f"{self.base}/data/{name}")
        return old

    def _exists(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def _change(self, s: Segment) -> Change:
        layout = self.layouts[s.table]
        empty = self.spark.createDataFrame([], layout.schema)
        read = lambda part, schema: self.spark.read.schema(schema).parquet(f"{self.base}/data/{part}")
        rows = read(f"{s.segment}/rows", empty.schema) if s.n_rows else empty
        keys = empty.select(*layout.key)
        return Change(rows, read(f"{s.gone_in}/gone", keys.schema) if s.n_gone else keys)

    def _table(self, table: str, segments: list[Segment]) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], self.layouts[table].schema)
        return merged([self._change(s) for s in segments], self.layouts[table].key)

    def _saved(self, df: DataFrame, path: str) -> int:
        """Writes a table and returns the number of its rows, by its files' footers."""
        df.write.parquet(f"{self.base}/data/{path}")
        return self.spark.read.schema(df.schema).parquet(f"{self.base}/data/{path}").count()

    def _keys(self, gone: DataFrame, key: tuple[str, ...]) -> tuple[str, int]:
        name = uuid.uuid4().hex
        return name, self._saved(gone.select(*key), f"{name}/gone")

    def _written(self, table: str, rows: DataFrame, gone_in: str, n_gone: int) -> Segment:
        layout, name = self.layouts[table], uuid.uuid4().hex
        rows = rows.select(*self.spark.createDataFrame([], layout.schema).columns)
        n = self._saved(rows.sortWithinPartitions(*layout.order) if layout.order else rows, f"{name}/rows")
        return Segment(table, name, n, gone_in, n_gone)

    def _settled(self, table: str, segments: list[Segment]) -> list[Segment]:
        """The segments, the newest merged where they have grown; what the oldest replaces is nothing."""
        first = first_to_merge([s.n_rows + s.n_gone for s in segments])
        if first == len(segments) - 1:
            return segments if first else [replace(segments[0], n_gone=0)]
        parts = [self._change(s) for s in segments[first:]]
        key = self.layouts[table].key
        gone = reduce(DataFrame.unionByName, (p.gone for p in parts)).distinct()
        place = self._keys(gone, key) if first else (segments[-1].gone_in, 0)
        return [*segments[:first], self._written(table, merged(parts, key), *place)]
