"""Growing transcript files as a stream of lines.

The offset is a map from file to the byte up to which its complete lines were read, so a
micro-batch reads of each file just what was appended, in ranges, and a restart goes on
from the checkpoint.  A file that got shorter was written anew and is read from its start
again; one rewritten to the same or a greater length is taken for grown.  Files that cannot
be read are left for a later batch.  Compressed files are not followed.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from quarryline.sources import files

_BLOCK = 1 << 16


def last_line_end(path: str, known: int, size: int) -> int:
    """Offset behind the last newline between two offsets, or ``known``; read from the end."""
    system, inner = files.located(path)
    with system.open_input_file(inner) as f:
        end = size
        while end > known:
            at = max(known, end - _BLOCK)
            f.seek(at)
            nl = f.read(end - at).rfind(b"\n")
            if nl >= 0:
                return at + nl + 1
            end = at
    return known


class _Tail(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root, self.source = options["path"].rstrip("/") or "/", options["source"]
        self.split = int(options.get("splitbytes", files.SPLIT_BYTES))
        self.seen: dict[str, tuple[int, int]] = {}  # size looked at, and the line end found

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        for _, _, path, size, _, error, _ in files.entries(self.source, self.root, self.root, deep=True):
            if error is not None or path.endswith((".zst", ".zstd")):
                continue
            was, end = self.seen.get(path, (0, 0))
            if size == was:
                continue
            try:
                self.seen[path] = size, last_line_end(path, end if size > was else 0, size)
            except (OSError, pa.ArrowException):
                continue
        return {"files": {path: end for path, (_, end) in sorted(self.seen.items())}}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for path, to in end["files"].items():
            begin = start["files"].get(path, 0)
            begin = 0 if to < begin else begin
            out += [(self.source, path, at, min(at + self.split, to), to, None, None, None) for at in range(begin, to, self.split)]
        return [files.FileRange(row) for row in out] or [files.FileRange(())]

    def read(self, partition: InputPartition):
        yield from files.line_batches(partition.value)


class TranscriptTail(DataSource):
    """``spark.readStream.format("transcript_tail")``: new records of a source below a path; options source and splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "transcript_tail"

    def schema(self) -> str:
        return files.LINES

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Tail(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TranscriptTail)
