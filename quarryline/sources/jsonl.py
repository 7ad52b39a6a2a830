"""Transcript files as lines with byte offsets."""

from __future__ import annotations

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: File name patterns of the sources.
GLOBS = {"codex": "*.jsonl", "claude-code": "*.jsonl", "pi": "*.jsonl", "dsh": "*.{zstd,zst}"}


def scan(spark: SparkSession, root: str, source: str) -> DataFrame:
    """Files of a source below a root: path, size, mtime; contents are not read.

    A missing root fails the read, other files are passed over.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", GLOBS[source]).load(root)
    plain = F.regexp_replace("path", "^file:(//)?", "")
    return files.select(F.lit(source).alias("source_id"), F.lit(root.rstrip("/")).alias("source_root"), plain.alias("file_path"), F.col("length").alias("size"), F.unix_millis("modificationTime").cast("double").alias("mtime_ms"))


def read_files(spark: SparkSession, root: str, source: str) -> DataFrame:
    """Files with their content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", GLOBS[source]).load(root)
    return files.select(F.lit(source).alias("source_id"), F.regexp_replace("path", "^file:(//)?", "").alias("file_path"), "content")


def prefix_digest(content: Column, size: Column) -> Column:
    """SHA-256 of the first bytes of a file."""
    return F.sha2(F.substring(content, F.lit(1), size), 256)


def lines(files: DataFrame, *, limit: int | None = None, parse_from: Column | int = 0, keep_tail: bool = False) -> DataFrame:
    """(source_id, file_path, line_no, raw_start, raw_end, value) of a file's records.

    A record ends with a newline; offsets leave it, and a carriage return before
    it, out.  Blank lines are passed over, and lines that are not UTF-8.  The unterminated tail is no record,
    unless ``keep_tail`` asks for it and the whole file was read.  ``limit`` bounds
    the bytes read, ``parse_from`` skips what was read before.
    """
    content = F.substring("content", 1, limit) if limit is not None else F.col("content")
    whole = F.lit(True) if limit is None else F.octet_length("content") <= limit
    # Bytes survive as Latin-1, so offsets are byte offsets whatever the text's encoding is.
    raw = files.select("source_id", "file_path", whole.alias("whole"), F.posexplode(F.split(F.decode(content, "ISO-8859-1"), "\n", -1)).alias("line_no", "raw"))
    order = Window.partitionBy("source_id", "file_path").orderBy("line_no")
    start = F.coalesce(F.sum(F.length("raw") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = F.lead("line_no").over(order).isNull()
    rows = raw.withColumns({"raw_start": start.cast("long"), "last": last})
    rows = rows.where((~F.col("last") | F.col("whole")) if keep_tail else ~F.col("last"))
    body = F.regexp_replace("raw", "\r$", "")
    rows = rows.select("source_id", "file_path", F.col("line_no").cast("long"), "raw_start", (F.col("raw_start") + F.length(body)).alias("raw_end"), F.encode(body, "ISO-8859-1").cast("string").alias("value"))
    return rows.where(F.is_valid_utf8("value") & (F.trim("value") != "") & (F.col("raw_start") >= parse_from))


def _unpack(batches):
    """(source_id, file_path, content) to the content's records; a cut last frame ends the file, other errors are rows.

    A file is unpacked as a stream; no more than a block and a line of it is held.
    """
    schema = pa.schema([("source_id", pa.string()), ("file_path", pa.string()), ("line_no", pa.int64()), ("value", pa.string()), ("error", pa.string())])
    made = lambda rows: pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    for batch in batches:
        for source, path, content in zip(*(c.to_pylist() for c in batch.columns)):
            out, number, parts, error = [], 0, [], None
            reader = zstandard.ZstdDecompressor().stream_reader(content, read_across_frames=True)
            while True:
                try:
                    block = reader.read(1 << 20)
                except zstandard.ZstdError as e:
                    error = str(e)
                    break
                if not block:  # the end, or as far as a cut frame goes
                    break
                *whole, rest = block.split(b"\n")
                for piece in whole:
                    line = b"".join([*parts, piece]).rstrip(b"\r")
                    parts = []
                    if line.strip():
                        out.append((source, path, number, line.decode("utf-8", "replace"), None))
                    number += 1
                parts.append(rest)
                if len(out) > 4096:
                    yield made(out)
                    out = []
            if error:
                out.append((source, path, -1, None, error))
            if out:
                yield made(out)


def lines_zstd(files: DataFrame) -> DataFrame:
    """Records of compressed files, offsets 0; a file that cannot be decoded gives one row with ``error``."""
    rows = files.select("source_id", "file_path", "content").mapInArrow(_unpack, "source_id string, file_path string, line_no bigint, value string, error string")
    return rows.withColumns({"raw_start": F.lit(0).cast("long"), "raw_end": F.lit(0).cast("long")})


def objects(rows: DataFrame) -> DataFrame:
    """Lines that are JSON objects; others are dropped, never an error."""
    return rows.where(F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"))


UUID = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"


def file_uuid(path: Column) -> Column:
    """First lower-case UUID of the file's name; "" if none."""
    return F.regexp_extract(F.element_at(F.split(path, "/"), -1), UUID, 0)


def path_date(path: Column) -> Column:
    """First YYYY/MM/DD of the path, else the date of a rollout file's name, else null."""
    triple = F.regexp_extract(path, r"(?:^|/)(\d{4})/(\d{2})/(\d{2})/", 0)
    day = F.regexp_replace(F.regexp_extract(triple, r"\d{4}/\d{2}/\d{2}", 0), "/", "-")
    name = F.regexp_extract(path, r"(?:^|/)rollout-(\d{4}-\d{2}-\d{2})T[^/]*$", 1)
    return F.when(day != "", day).when(name != "", name)


def cold_ids(spark: SparkSession, roots: list[str]) -> DataFrame:
    """Native ids that archived trees hold: the last UUID of each file name; contents are not read.

    A root that is missing fails, so pruning cannot take silence for absence.
    """
    out = None
    for root in roots:
        f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.element_at(F.split("path", "/"), -1).alias("name"))
        out = f if out is None else out.unionByName(f)
    return ids_of_names(out)


def ids_of_names(names: DataFrame) -> DataFrame:
    """Distinct native_session_id: the last UUID of each transcript's file name."""
    names = names.where(F.col("name").rlike(r"\.jsonl(\.zst)?$"))
    ids = F.regexp_extract_all(F.lower("name"), F.lit(f"({UUID})"), F.lit(1))
    return names.where(F.size(ids) > 0).select(F.element_at(ids, -1).alias("native_session_id")).distinct()
