"""WARC archives compressed record by record with a Zstandard dictionary.

Each task writes archives of its own partition.  The records that open an
archive are a sample from which a dictionary is trained, the smaller the fewer they
are; the dictionary is the content of a skippable frame at the head of the file, and every record is one
frame compressed with it, so a record can be read without the ones before it.
Archives go to a folder that driver and executors share, under names that no
other attempt of the task uses; only names that a committed manifest holds count,
so a lost or repeated task leaves at most files that nobody reads.

Records with equal payloads are written once: the smallest page id is the
response and the others revisit it.
"""

from __future__ import annotations

import hashlib
import struct
import uuid

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import shared_path, stash, trained_dictionary

#: Fixed values of the format: magic number of the dictionary's skippable frame, and the revisit profile.
DICTIONARY_MAGIC = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "archive string, records bigint, bytes bigint, dictionary_bytes bigint"
RECORD = "archive string, page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary"


def filesystem(uri: str):
    """A file system that tasks can open, and the path in it; s3a is the same store as s3.

    The path names its store: ``write_archives`` has Spark complete a path without a scheme.
    """
    if uri.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def qualified(spark, folder: str) -> str:
    """The folder with the scheme that Spark itself would resolve it by."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


def _id(page: int | None) -> str:
    return f"<urn:page:{'null' if page is None else page}>"


def _page(urn: str) -> int | None:
    text = urn.strip("<>").rpartition(":")[2]
    return None if text == "null" else int(text)


def _breaks(url: str | None) -> list[tuple[int, int]]:
    """Places of line breaks in an address, and which they are; a header cannot hold them."""
    return [(i, ord(c)) for i, c in enumerate(url or "") if c in "\r\n"]


def _with_breaks(url: str, breaks: str | None) -> str:
    """The address as it was before its breaks became %0A and %0D."""
    for place in (breaks or "").split(",") if breaks else ():
        i, c = map(int, place.split(":"))
        url = url[:i] + chr(c) + url[i + 3 :]
    return url


def render_record(page: int | None, url: str | None, payload: bytes, digest: str, size: int, refers: int | None, revisit: bool, date: str) -> bytes:
    """One WARC/1.1 record; a revisit has HTTP headers and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_id(page)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {(url or '').translate({10: '%0A', 13: '%0D'})}",
        *([f"X-Line-Breaks: {','.join(f'{i}:{c}' for i, c in breaks)}"] if (breaks := _breaks(url)) else []),
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_id(refers)}"]
    if url is None:
        head.append("X-Null-Target: true")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _writer(folder: str, date: str, archive_bytes: int, sample_bytes: int, dictionary_bytes: int, level: int):
    def write(batches):
        fs, base = filesystem(folder)
        state = {"out": None, "sample": [], "held": 0}

        def open_archive():
            samples = state["sample"]
            blob = trained_dictionary(samples, dictionary_bytes)
            d = zstandard.ZstdCompressionDict(blob)
            d.precompute_compress(level=level)
            name = f"pages-{uuid.uuid4().hex}.warc.zst"
            fs.create_dir(base, recursive=True)
            out = fs.open_output_stream(f"{base}/{name}", compression=None)
            out.write(struct.pack("<II", DICTIONARY_MAGIC, len(blob)) + blob)
            state.update(out=out, name=name, size=8 + len(blob), raw=0, records=0, dict=len(blob), compress=zstandard.ZstdCompressor(level=level, dict_data=d).compress)
            for record in samples:
                put(record)
            state.update(sample=[], held=0)

        def put(record):
            frame = state["compress"](record)
            state["out"].write(frame)
            state["size"] += len(frame)
            state["raw"] += len(record)
            state["records"] += 1

        def close():
            state["out"].close()
            row = (state["name"], state["records"], state["size"], state["dict"])
            state["out"] = None
            return pa.record_batch([pa.array([x], t) for x, t in zip(row, (pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["archive", "records", "bytes", "dictionary_bytes"])

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "payload_digest", "payload_bytes", "refers_to", "revisit")]
            for page, url, payload, digest, size, refers, revisit in zip(*(map(lambda x: x.as_py(), c) for c in columns)):
                record = render_record(page, url, payload, digest, size, refers, revisit, date)
                if state["out"] is None:
                    state["sample"].append(record)
                    state["held"] += len(record)
                    if state["held"] >= sample_bytes:
                        open_archive()
                else:
                    put(record)
                    if state["raw"] >= archive_bytes:
                        yield close()
        if state["sample"]:
            open_archive()
        if state["out"] is not None:
            yield close()

    return write


def classify(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 100) -> DataFrame:
    """(page_id, url, payload, payload_digest, payload_bytes, refers_to, revisit) of every page.

    Null pages have empty payloads.  Of equal payloads of ``least_bytes`` or more
    the smallest id is the response; rows that share that id are all responses.
    A null id comes after all others.
    """
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"payload_digest": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("long")})
    slim = rows.where(F.col("payload_bytes") >= least_bytes).select("payload_digest", "page_id")
    # Only digests that occur again matter; the rest of the pages find no partner.
    first = slim.groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = rows.join(first, "payload_digest", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select("page_id", "url", F.when(~revisit, F.col("payload")).otherwise(F.lit(b"")).alias("payload"), "payload_digest", "payload_bytes", F.when(revisit, F.col("first_id")).alias("refers_to"), revisit.alias("revisit"))


def write_archives(
    pages: DataFrame,
    folder: str,
    *,
    date: str = "2024-01-01T00:00:00Z",
    archive_bytes: int = 256 << 20,
    sample_bytes: int = 2 << 20,
    dictionary_bytes: int = 65536,
    level: int = 3,
    **columns,
) -> DataFrame:
    """Writes the pages' records to archives in ``folder``; returns the committed manifest."""
    folder = qualified(pages.sparkSession, folder)
    rows = classify(pages, **columns)
    return stash(rows.mapInArrow(_writer(folder, date, archive_bytes, sample_bytes, dictionary_bytes, level), MANIFEST))


def _records(stream):
    """Parsed records of an open archive, one at a time."""
    head = stream.read(8)
    blob = b""
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == DICTIONARY_MAGIC:
        blob = stream.read(struct.unpack("<I", head[4:])[0])
        head = b""
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(blob) if blob else None)

    class Joined:
        """The bytes already read, then the rest."""

        def __init__(self):
            self.first = head

        def read(self, n=-1):
            if self.first:
                part, self.first = self.first, b""
                return part
            return stream.read(n)

    reader = d.stream_reader(Joined(), read_across_frames=True, read_size=1 << 18)
    held = b""

    def until(mark):
        nonlocal held
        while (at := held.find(mark)) < 0:
            part = reader.read(1 << 18)
            if not part:
                return None
            held += part
        line, held = held[:at], held[at + len(mark) :]
        return line

    def exactly(n):
        nonlocal held
        parts, have = [held], len(held)
        while have < n:
            part = reader.read(max(1 << 18, n - have))
            if not part:
                raise ValueError("a record ends early")
            parts.append(part)
            have += len(part)
        data = b"".join(parts)
        held = data[n:]
        return data[:n]

    while (head_block := until(b"\r\n\r\n")) is not None:
        lines = head_block.decode("utf-8", "surrogatepass").split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError("not a WARC record")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        block = exactly(int(fields["Content-Length"]))
        if exactly(4) != b"\r\n\r\n":
            raise ValueError("a record has no end mark")
        yield fields, block


def _reader(folder: str, with_payload: bool):
    def read(batches):
        fs, base = filesystem(folder)
        names = [n for n, _ in (x.split(":") for x in RECORD.replace(" ", ":").split(",:"))]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                rows, heavy = [], 0
                with fs.open_input_stream(f"{base}/{archive}", compression=None) as stream:
                    for fields, block in _records(stream):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                        revisit = fields["WARC-Type"] == "revisit"
                        if not revisit and hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"{archive}: a payload doesn't match its digest")
                        size = int(http.rpartition(b"Content-Length: ")[2]) if revisit else len(payload)
                        url = None if "X-Null-Target" in fields else _with_breaks(fields["WARC-Target-URI"], fields.get("X-Line-Breaks"))
                        rows.append((archive, _page(fields["WARC-Record-ID"]), url, fields["WARC-Type"], size, digest, _page(fields["WARC-Refers-To"]) if revisit else None, payload if with_payload and not revisit else None))
                        heavy += len(payload) if with_payload else 200
                        if heavy > 8 << 20:
                            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                            rows, heavy = [], 0
                if rows:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return read


def read_archives(manifest: DataFrame, folder: str, *, with_payload: bool = True) -> DataFrame:
    """Rows of ``RECORD`` from the archives that the manifest names, a task for a few archives each.

    Payload digests of responses are checked; a broken archive fails the read.
    """
    folder = qualified(manifest.sparkSession, folder)
    n = max(1, min(manifest.count(), 100_000))
    return manifest.select("archive").repartition(n).mapInArrow(_reader(folder, with_payload), RECORD)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Writes the pages to archives in the shared folder and reads them back."""
    folder = shared_path(pages.sparkSession)
    return read_archives(write_archives(pages, folder, **options), folder, with_payload=False)


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to FROM f
"""
