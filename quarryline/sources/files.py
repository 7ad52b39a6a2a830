"""Transcript files where they lie: listings, digests, and lines by byte ranges.

No step holds a whole file or takes one in a single row.  A folder or file that cannot be
read is a row with ``error``, not the end of the job.  Paths are local or URIs of stores
that ``pyarrow.fs`` reaches from the executors.

A plain file is cut into ranges of ``split_bytes``; a line belongs to the range that it
starts in.  A compressed file is cut between frames; a line belongs to the frame that it
starts in.  Lines are numbered so that their order is that of the file and a file that
grows keeps the numbers it had: by their offset, or by frame and offset inside it.
"""

from __future__ import annotations

import fnmatch
import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quarryline.storage import keep

#: File name patterns of the sources.
PATTERNS = {"codex": ("*.jsonl",), "claude-code": ("*.jsonl",), "pi": ("*.jsonl",), "dsh": ("*.zstd", "*.zst")}
COMPRESSED = r"\.zstd?$"
SPLIT_BYTES = 64 << 20
_BLOCK = 1 << 20
_FRAME_SHIFT = 40
_BATCH_ROWS = 4096

FILES = "source_id string, source_root string, file_path string, size bigint, mtime_ms double, error string"
_ENTRIES = FILES + ", folder boolean"
LINES = "source_id string, file_path string, line_no bigint, raw_start bigint, raw_end bigint, value string, error string"
RANGES = "source_id string, file_path string, start bigint, end bigint, size bigint, before bigint, frame bigint, error string"


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def _batches(rows, ddl: str) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded number and size."""
    schema, out, size = _schema(ddl), [], 0
    value = schema.get_field_index("value")
    for row in rows:
        out.append(row)
        size += len(row[value] or "") if value >= 0 else 0
        if len(out) == _BATCH_ROWS or size > 8 << 20:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out, size = [], 0
    if out:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def _rows(batches) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def plain(path: str) -> str:
    """A URI of this machine as a path; others stay."""
    return re.sub(r"^file:(//)?(?=/)", "", path)


def located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _named(path: str, inner: str) -> str:
    """The path of a file below ``path``, in the same form."""
    return path.split("://")[0] + "://" + inner if "://" in path and not path.startswith("file:") else inner


# Listings


def _children(folder: str) -> Iterator[tuple[str, str, bool, bool, int | None, float | None]]:
    """(path, name, is a folder, is a file, size, mtime in ms) of what is in a folder."""
    system, inner = located(folder)
    if isinstance(system, fs.LocalFileSystem):  # which would pass over links to nowhere
        with os.scandir(inner) as found:
            for e in found:
                there = e.stat() if e.is_file() else None
                yield e.path, e.name, e.is_dir(), e.is_file(), there and there.st_size, there and there.st_mtime_ns / 1e6
    else:
        for i in system.get_file_info(fs.FileSelector(inner)):
            yield _named(folder, i.path), i.base_name, i.type == fs.FileType.Directory, i.is_file, i.size, i.mtime_ns and i.mtime_ns / 1e6


def entries(source: str, root: str, folder: str, *, deep: bool) -> Iterator[tuple]:
    """Files below a folder as rows; without ``deep`` its own only, and the folders in it."""
    open_ = [folder]
    while open_:
        here = open_.pop()
        try:
            for path, name, is_folder, is_file, size, mtime in _children(here):
                if is_folder and deep:
                    open_.append(path)
                elif is_folder:
                    yield source, root, path, None, None, None, True
                elif any(fnmatch.fnmatch(name, p) for p in PATTERNS[source]):
                    yield source, root, path, size, mtime, None if is_file else "no regular file", False
        except (OSError, pa.ArrowException) as e:
            yield source, root, here, None, None, str(e), False


def listed(roots: DataFrame) -> DataFrame:
    """Files (source_id, source_root, file_path, size, mtime_ms, error) below roots (source_id, source_root).

    A root's folders are listed in parallel.  What cannot be listed is a row with its path and ``error``.
    """
    look = lambda deep: lambda batches: _batches((e for s, r, f in _rows(batches) for e in entries(s, r, f, deep=deep)), _ENTRIES)
    plain = F.regexp_replace("source_root", "(?<=.)/$", "")
    top = keep(roots.select("source_id", plain.alias("source_root"), plain.alias("folder")).distinct().mapInArrow(look(False), _ENTRIES))
    folders = top.where("folder").select("source_id", "source_root", F.col("file_path").alias("folder"))
    parts = int(roots.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    deeper = folders.repartition(parts, "folder").mapInArrow(look(True), _ENTRIES)
    return top.unionByName(deeper).where("not folder").drop("folder")


# Digests


def _digests(path: str, prefix: int | None, size: int) -> tuple:
    """(SHA-256 of the whole, of its first bytes, bytes up to the last newline, error) of the first ``size`` bytes."""
    try:
        system, inner = located(path)
        whole, first, at, last = hashlib.sha256(), None, 0, 0
        with system.open_input_stream(inner, compression=None) as f:
            while at < size:
                edge = prefix if prefix is not None and at < prefix < size else size
                block = f.read(min(_BLOCK, edge - at))
                if not block:
                    return None, None, None, f"{at} bytes in place of {size}"
                whole.update(block)
                nl = block.rfind(b"\n")
                last = at + nl + 1 if nl >= 0 else last
                at += len(block)
                first = whole.hexdigest() if at == prefix else first
        empty = hashlib.sha256().hexdigest()
        return whole.hexdigest(), empty if prefix == 0 else first, last, None
    except (OSError, pa.ArrowException) as e:
        return None, None, None, str(e)


def digested(files: DataFrame, prefix: Column) -> DataFrame:
    """Files with content_sha, prefix_sha (of the first ``prefix`` bytes), read_bytes (up to the last newline) and error.

    Each is read once, as a stream, up to its listed size.
    """
    columns = [c for c in files.columns if c != "error"]

    def read(batches):
        for batch in batches:
            found = [_digests(p, n, s) for p, n, s in zip(*(batch.column(c).to_pylist() for c in ("file_path", "__prefix", "size")))]
            kinds = (pa.string(), pa.string(), pa.int64(), pa.string())
            kept = [batch.column(c) for c in columns]
            read = [pa.array(c, k) for c, k in zip(zip(*found) if found else ((),) * 4, kinds)]
            yield pa.record_batch([*kept, *read], [*columns, "content_sha", "prefix_sha", "read_bytes", "error"])

    rows = files.select(*columns, prefix.cast("long").alias("__prefix"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.select(*columns).schema.fields)
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "file_path").mapInArrow(read, schema + ", content_sha string, prefix_sha string, read_bytes bigint, error string")


# Ranges


def frames(f, start: int, size: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the Zstandard frames from ``start`` on, by their block headers; a torn last one ends with the file."""

    def number(n: int) -> int | None:
        raw = f.read(n)
        return int.from_bytes(raw, "little") if len(raw) == n else None

    def end_of(at: int) -> int | None:
        f.seek(at)
        magic = number(4)
        if magic is not None and magic >> 4 == 0x184D2A5:
            n = number(4)
            return None if n is None else at + 8 + n
        if magic is None:
            return None
        if magic != 0xFD2FB528:
            raise ValueError(f"no frame at byte {at}")
        flags = number(1)
        if flags is None:
            return None
        single = flags >> 5 & 1
        sizes = (1 if single else 0, 2, 4, 8)[flags >> 6]
        here = at + 5 + (0 if single else 1) + (0, 1, 2, 4)[flags & 3] + sizes
        last = 0
        while not last:
            f.seek(here)
            head = number(3)
            if head is None:
                return None
            last = head & 1
            here += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        return here + (4 if flags >> 2 & 1 else 0)

    while start < size:
        end = end_of(start)
        end = size if end is None or end > size else end
        yield start, end
        start = end


def frame_ranges(source: str, path: str, size: int, split: int) -> Iterator[tuple]:
    """Ranges of whole frames of ``split`` bytes or more; ``before`` is the start of the frame in front, ``frame`` the first's number."""
    try:
        system, inner = located(path)
        with system.open_input_file(inner) as f:
            held, before, none = [], None, True
            for k, (lo, hi) in enumerate(frames(f, 0, size)):
                none = False
                held.append((k, lo))
                if hi - held[0][1] >= split or hi >= size:
                    yield source, path, held[0][1], hi, size, before, held[0][0], None
                    held, before = [], lo
            if none and size:
                raise ValueError("no frame")
    except (OSError, ValueError, pa.ArrowException) as e:
        yield source, path, None, None, size, None, None, str(e)


def ranges(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Pieces to read of files (source_id, file_path, size, from_byte); compressed files are always read from their start."""
    packed = F.col("file_path").rlike(COMPRESSED)
    rest = files.where(~packed & (F.col("size") > F.col("from_byte")))
    none = F.lit(None)
    starts = F.explode(F.sequence(F.col("from_byte"), F.col("size") - 1, F.lit(split_bytes).cast("long"))).alias("start")
    plain = rest.select("source_id", "file_path", "size", starts).select(
        "source_id", "file_path", "start", F.least(F.col("start") + split_bytes, "size").alias("end"), "size",
        none.cast("long").alias("before"), none.cast("long").alias("frame"), none.cast("string").alias("error"),
    )
    walk = lambda batches: _batches((r for s, p, n in _rows(batches) for r in frame_ranges(s, p, n, split_bytes)), RANGES)
    return plain.unionByName(files.where(packed).select("source_id", "file_path", "size").mapInArrow(walk, RANGES))


# Lines


def _cut(blocks: Iterator[tuple[int, bytes]], begin: int | None, stop) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, bytes) of terminated lines in blocks (offset, bytes); ``begin`` None waits for the first newline.

    ``stop(start)`` says where a line starts that is no longer wanted.
    """
    parts: list[bytes] = []
    for at, block in blocks:
        lo = 0
        while (nl := block.find(b"\n", lo)) >= 0:
            if begin is not None:
                parts.append(block[lo:nl])
                yield begin, at + nl, b"".join(parts)
            parts, lo = [], nl + 1
            begin = at + lo
            if stop(begin):
                return
        if begin is not None:
            parts.append(block[lo:])


def plain_lines(path: str, start: int, end: int, size: int) -> Iterator[tuple[int, int, bytes]]:
    """(offset, offset of the newline, bytes) of the lines that start in a range and end before ``size``."""
    system, inner = located(path)
    with system.open_input_file(inner) as f:

        def blocks():
            at = max(start - 1, 0)
            f.seek(at)
            while at < size and (block := f.read(min(_BLOCK, size - at))):
                yield at, block
                at += len(block)

        yield from _cut(blocks(), 0 if start == 0 else None, lambda at: at >= end)


def _unpacked(f, lo: int, hi: int) -> Iterator[bytes]:
    """Blocks of a frame's content; a torn frame gives what it has."""
    f.seek(lo)
    unpack, left = zstandard.ZstdDecompressor().decompressobj(), hi - lo
    while left and (packed := f.read(min(_BLOCK, left))):
        left -= len(packed)
        yield unpack.decompress(packed)


def frame_lines(path: str, start: int, end: int, size: int, before: int | None, frame: int) -> Iterator[tuple[int, bytes]]:
    """(number, bytes) of the lines that start in a range of frames."""
    system, inner = located(path)
    with system.open_input_file(inner) as f:
        begin: int | None = frame << _FRAME_SHIFT
        if before is not None:
            last = b""
            for block in _unpacked(f, before, start):
                last = block[-1:] or last
            begin = begin if last == b"\n" else None
        limit = [None]

        def blocks():
            for k, (lo, hi) in enumerate(frames(f, start, size), frame):
                if lo >= end and limit[0] is None:
                    limit[0] = k << _FRAME_SHIFT
                at, back = k << _FRAME_SHIFT, hi
                for block in _unpacked(f, lo, hi):
                    yield at, block
                    at += len(block)
                f.seek(back)

        first_after = lambda: limit[0]
        for lo, _, data in _cut(blocks(), begin, lambda at: first_after() is not None and at >= first_after()):
            if first_after() is not None and lo >= first_after():
                return
            yield lo, data


def range_lines(source: str, path: str, start, end, size, before, frame, error) -> Iterator[tuple]:
    """Rows of a range's records: lines that are not blank and are UTF-8; a fault is a row with ``error``."""
    if error is not None:
        yield source, path, None, None, None, None, error
        return
    try:
        if frame is None:
            found = ((lo, lo, data) for lo, _, data in plain_lines(path, start, end, size))
        else:
            found = ((no, None, data) for no, data in frame_lines(path, start, end, size, before, frame))
        for no, lo, data in found:
            data = data.removesuffix(b"\r")
            if not data.strip(b" "):
                continue
            try:
                text = data.decode()
            except UnicodeDecodeError:
                continue
            yield source, path, no, lo or 0, 0 if lo is None else lo + len(data), text, None
    except (OSError, ValueError, zstandard.ZstdError, pa.ArrowException) as e:
        yield source, path, None, None, None, None, str(e)


def lines(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Lines of files (source_id, file_path, size, from_byte), read by ranges; offsets of compressed ones are 0."""
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    read = lambda batches: _batches(chain.from_iterable(range_lines(*r) for r in _rows(batches)), LINES)
    pieces = ranges(files, split_bytes).select(*(c.split()[0] for c in RANGES.split(", ")))
    return pieces.repartition(parts, "file_path", "start").mapInArrow(read, LINES)


def line_batches(piece: tuple) -> Iterator[pa.RecordBatch]:
    """Lines of a range, of none for an empty piece."""
    return _batches(range_lines(*piece) if piece else (), LINES)


class FileRange(InputPartition):
    def __init__(self, row: tuple):
        super().__init__(row)


class _LineReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.source = options["path"].rstrip("/") or "/", options["source"]
        self.split = int(options.get("splitbytes", SPLIT_BYTES))

    def partitions(self) -> list[InputPartition]:
        out = []
        for _, _, path, size, _, error, _ in entries(self.source, self.root, self.root, deep=True):
            if error is not None:
                out.append((self.source, path, None, None, None, None, None, error))
            elif path.endswith((".zst", ".zstd")):
                out += frame_ranges(self.source, path, size, self.split)
            else:
                out += [(self.source, path, at, min(at + self.split, size), size, None, None, None) for at in range(0, size, self.split)]
        return [FileRange(row) for row in out] or [FileRange(())]

    def read(self, partition: InputPartition):
        yield from line_batches(partition.value)


class TranscriptLines(DataSource):
    """``spark.read.format("transcript_lines")``: the records of a source below a path; options source and splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "transcript_lines"

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> DataSourceReader:
        return _LineReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TranscriptLines)
