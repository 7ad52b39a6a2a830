"""Exact removal of repeated byte strings by a logarithmic family of suffix arrays.

A byte is removed if a string of ``length`` (100) bytes over it also starts
earlier: in an earlier document, or earlier in the same one.

Equal texts are settled by their SHA-256: all but the first are removed whole, and
only distinct texts go on.  These are numbered in the order of their first id, and
come in batches of rising number, each of about ``batch_bytes``, four at least.

A batch gets a sparse suffix array: of each run of windows that agree on their
smallest 32-byte string, the suffix that starts with that string is kept, and the
array is in the byte order of these 32 bytes, ties by the run's fingerprint.
Equal windows choose equal suffixes wherever they stand, so every long match
meets under one key.  Arrays are bucketed by key.  The batch is dealt to the same
buckets and merge-scanned against the levels of the index, bucket by bucket, where
they lie: levels are never shuffled again.  A run that occurs earlier as a whole is
a match at once (32 bytes and 128 bits of fingerprint agree); runs that share a key
but are not equal are compared byte by byte afterwards.  Then the batch becomes a
level, and levels of equal size are merged, bucket by bucket, so a suffix is
rewritten a logarithmic number of times.

A key that ``_CROWD`` different runs of one task's buffer or ``_GROUP`` rows of a
bucket share is crowded: what surrounds a frequent passage is.  Crowded runs are not
compared run by run; their windows are dealt out and counted by 128 bits of the
window's own fingerprint, which splits the key.  So a bucket gets at most ``_CROWD``
rows of a key from each ``_TASK_BYTES`` of text, and equality within crowds is that of
fingerprints (two of 10^14 windows agree by chance with probability under 10^-10).
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.llm.common import CLEAN, join_counted, remove_folder, settings, shared_path, stash

GRAM = 32
_SEGMENT = 1 << 20
_TASK_BYTES = 32 << 20
_CROWD = 64
#: Least number of batches: each more costs another look at the levels, each less makes a batch's share of the disk larger.
_BATCHES = 4
_GROUP = 4096
_MULTIPLIER = 0x9E3779B97F4A7C15
_SECOND = 0xD1342543DE82EF95
ENTRY, MARKER, COMPARE, COVERED = 0, 1, 2, 3
OLD = 8  # added to the kind of rows that come from a level
#: ``key`` is the suffix's first 32 bytes; ``place`` is the first window's start (high half) and the number of windows (low half).
ENTRIES = "key binary, run bigint, run2 bigint, row bigint, place bigint, kind int"
LEVEL, BYTES, WHOLE, WINDOWS = 1, 2, 4, 8  # bits of ``what``
COVERS = "row bigint, lo int, n int"


def _powers(n: int, base: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


class Hashes:
    """Fingerprints of the GRAM-byte strings of a text, and of longer stretches by prefix sums.

    ``stretch`` sums up the fingerprints of the strings, ``stretch2`` the bytes
    themselves, eight at a time; the two are independent.
    """

    _forth = _powers(_SEGMENT + 512, _MULTIPLIER)
    _back = _powers(_SEGMENT + 512, pow(_MULTIPLIER, -1, 1 << 64))
    _forth2 = _powers(_SEGMENT + 512, _SECOND)
    _back2 = _powers(_SEGMENT + 512, pow(_SECOND, -1, 1 << 64))

    def __init__(self, data: bytes):
        n = len(data)
        self.bytes = np.frombuffer(data, np.uint8)
        words = np.empty(max(n - 7, 0), np.uint64)
        for i in range(min(8, len(words))):
            words[i::8] = np.frombuffer(data, "<u8", (n - i) // 8, i)
        m = max(n - GRAM + 1, 0)
        h = np.zeros(m, np.uint64)
        for j, c in enumerate((0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93)):
            part = words[8 * j : 8 * j + m] * np.uint64(c)
            part ^= part >> np.uint64(29 + j)
            h += part
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(31)
        self.gram = h
        zero = np.zeros(1, np.uint64)
        self.sums = np.concatenate((zero, np.cumsum(h * self._forth[:m])))
        mixed = words ^ words >> np.uint64(29)
        self.sums2 = np.concatenate((zero, np.cumsum(mixed * self._forth2[: len(words)])))

    def stretch(self, lo: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """Fingerprints of the stretches of ``size`` bytes (GRAM or more) from ``lo``."""
        h = (self.sums[lo + size - GRAM + 1] - self.sums[lo]) * self._back[lo]
        return (h ^ h >> np.uint64(32)).view(np.int64)

    def stretch2(self, lo: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """The same by another sum."""
        h = (self.sums2[lo + size - 7] - self.sums2[lo]) * self._back2[lo]
        return (h ^ h >> np.uint64(32)).view(np.int64)

    def grams(self, at: np.ndarray) -> np.ndarray:
        """The GRAM bytes from each place, a row each."""
        return np.lib.stride_tricks.sliding_window_view(self.bytes, GRAM)[at]


def _runs(hashes: Hashes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, smallest gram) of the runs of windows that agree on that gram."""
    grams = hashes.gram
    windows = len(grams) - (length - GRAM)
    mask = np.uint64((1 << 21) - 1)
    least = (grams & ~mask) | np.arange(len(grams), dtype=np.uint64)
    want, have = length - GRAM + 1, 1
    while have < want:
        step = min(have, want - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    at = (least[:windows] & mask).astype(np.int64)
    lo = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))
    return lo, np.diff(np.append(lo, windows)), at[lo]


def _segments(data: bytes, length: int, size: int):
    """(offset, piece) so that every window is in one piece; one piece for all but very long texts."""
    step = size - length
    for at in range(0, max(len(data) - length + 1, 0), step):
        yield at, data[at : at + step + length - 1]


def _spread(row: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Eight bytes that deal out rows which need no key of their own."""
    h = (row.view(np.uint64) * np.uint64(_MULTIPLIER)) ^ (lo.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return h.view(np.uint8).reshape(-1, 8)


def _merged(row, lo, n):
    """Joins runs that follow one another in a document; sorted by document and start."""
    order = np.lexsort((lo, row))
    row, lo, n = row[order], lo[order], n[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (lo[1:] > lo[:-1] + n[:-1])
    first = np.flatnonzero(fresh)
    if not len(first):
        return row, lo, n
    ends = np.maximum.reduceat(lo + n, first)
    return row[first], lo[first], ends - lo[first]


def _binary(values: np.ndarray) -> pa.Array:
    """Rows of bytes as binary values."""
    k, width = values.shape
    ends = np.arange(0, (k + 1) * width, width, dtype=np.int32)
    data = pa.py_buffer(np.ascontiguousarray(values))
    return pa.Array.from_buffers(pa.binary(), k, [None, pa.py_buffer(ends), data])


def _entries(key, kind: int, run, run2, row, lo, n):
    """Record batches of ENTRIES rows of one kind."""
    for i in range(0, len(row), 50_000):
        part = slice(i, i + 50_000)
        place = lo[part] << 32 | n[part]
        columns = [pa.array(x) for x in (run[part], run2[part], row[part], place)]
        kinds = pa.array(np.full(len(place), kind, np.int32))
        yield pa.record_batch([_binary(key[part]), *columns, kinds], ["key", "run", "run2", "row", "place", "kind"])


def _build(length: int):
    """(row, text) to the tasks' part of a suffix array: ENTRIES rows of their documents."""

    def run(batches):
        def flush(parts):
            key, gram, runs, runs2, row, lo, n = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((lo, row, runs2, runs, key))
            key, gram, runs, runs2, row, lo, n = (x[order] for x in (key, gram, runs, runs2, row, lo, n))
            fresh_key = np.ones(len(key), bool)
            fresh_key[1:] = (key[1:] != key[:-1]) | (gram[1:] != gram[:-1]).any(axis=1)
            fresh = fresh_key.copy()
            fresh[1:] |= (runs[1:] != runs[:-1]) | (runs2[1:] != runs2[:-1])
            group = np.cumsum(fresh_key) - 1
            crowd = (np.bincount(group, weights=fresh) > _CROWD)[group]
            plain = fresh & ~crowd
            yield from _entries(gram[plain], ENTRY, *(x[plain] for x in (runs, runs2, row, lo, n)))
            marks = crowd & fresh_key
            yield from _entries(gram[marks], MARKER, *(x[marks] for x in (runs, runs2, row, lo, n)))
            some = crowd & fresh
            zeros = np.zeros(int(some.sum()), np.int64)
            yield from _entries(_spread(row[some], lo[some]), COMPARE, zeros, zeros, row[some], lo[some], n[some])
            d, a, m = _merged(row[~fresh], lo[~fresh], n[~fresh])
            zeros = np.zeros(len(d), np.int64)
            yield from _entries(_spread(d, a), COVERED, zeros, zeros, d, a, m)

        parts, heavy = [], 0
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())):
                for offset, piece in _segments(text.as_py(), length, _SEGMENT):
                    h = Hashes(piece)
                    lo, n, at = _runs(h, length)
                    size = n + length - 1
                    parts.append((h.gram[at], h.grams(at), h.stretch(lo, size), h.stretch2(lo, size), np.full(len(lo), row), lo + offset, n))
                    heavy += len(piece)
                    if heavy >= _TASK_BYTES:
                        yield from flush(parts)
                        parts, heavy = [], 0
        if parts:
            yield from flush(parts)

    return run


def _scan(rows: DataFrame, crowd: int) -> DataFrame:
    """Merge scan of a batch and the levels: adds ``what``, the bits of what is to be done with a row.

    All rows of a key are in one partition, since the batch is dealt to the levels' buckets.
    """
    same_key = Window.partitionBy("key")
    same_run = Window.partitionBy("key", "run", "run2").orderBy("row", "place")
    kind = F.col("kind").bitwiseAND(F.lit(OLD - 1))
    marked = F.max((kind == MARKER).cast("int")).over(same_key) > 0
    run = F.struct("run", "run2")
    # The finer order first: it serves both windows.
    flagged = rows.withColumns({"first_row": F.first("row").over(same_run), "first_place": F.first("place").over(same_run)})
    flagged = flagged.withColumns({
        "mixed": F.min(run).over(same_key) != F.max(run).over(same_key),
        "crowded": marked | (F.count("*").over(same_key) > crowd),
        "touched": F.min("kind").over(same_key) < OLD,
    })
    entry, fresh = kind == ENTRY, F.col("kind") < OLD
    first = entry & (F.col("row") == F.col("first_row")) & (F.col("place") == F.col("first_place"))
    compare = first & (F.col("mixed") | F.col("crowded")) & F.col("touched")
    what = (
        F.when(fresh & (first | (kind == MARKER)), LEVEL).otherwise(0)
        + F.when(compare & ~F.col("crowded"), BYTES).otherwise(0)
        + F.when((entry & fresh & ~first) | (kind == COVERED), WHOLE).otherwise(0)
        + F.when((compare & F.col("crowded")) | (kind == COMPARE), WINDOWS).otherwise(0)
    )
    flagged = flagged.withColumns({"what": what, "matched": what > LEVEL}).where("what > 0")
    return flagged.select("key", "run", "run2", "row", "place", kind.alias("kind"), "what", "matched")


class SuffixIndex:
    """Levels of suffixes, each twice as large as the next smaller one.

    ``add`` scans a batch, whose rows must be above those added before, and keeps what
    it found; ``rows`` gives it back.  Levels are tables in the shared folder, bucketed by
    key; ``close`` deletes them.
    """

    def __init__(self, spark, buckets: int, length: int = 100, crowd: int | None = None):
        self.spark, self.buckets, self.length = spark, buckets, length
        self.crowd = _GROUP if crowd is None else crowd
        self.levels: list[tuple[int, str]] = []  # (batches in it, table)
        self.found: list[str] = []  # tables of the batches
        self.folders: dict[str, str] = {}

    def _write(self, rows: DataFrame, *parts: str) -> str:
        name, path = save_bucketed(rows, self.buckets, "key", *parts)
        self.folders[name] = path
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove_folder(self.spark, self.folders.pop(name))

    def _level(self, name: str) -> DataFrame:
        return self.spark.table(name).where("what % 2 = 1").select("key", "run", "run2", "row", "place", "kind")

    def add(self, docs: DataFrame, *, last: bool = False) -> None:
        """docs: (row, text), no text shorter than a window.  ``last``: nothing follows, so the batch needs no level."""
        held = shared_path(self.spark)
        docs.select("row", "text").mapInArrow(_build(self.length), ENTRIES).write.parquet(held)
        batch = self.spark.read.schema(ENTRIES).parquet(held)
        rows = batch.repartition(self.buckets, "key")
        # Of a level, only keys that the batch has matter; its bucket is probed where it lies.
        keys = batch.select("key").repartition(self.buckets, "key").hint("shuffle_hash")
        for _, name in self.levels:
            level = self._level(name).join(keys, "key", "left_semi")
            rows = rows.unionByName(level.withColumn("kind", (F.col("kind") + OLD).cast("int")))
        found = _scan(rows, self.crowd)
        name = self._write(found.where("matched") if last else found, "matched")
        remove_folder(self.spark, held)
        self.found.append(name)
        if last:
            return
        self.levels.append((1, name))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            self._merge(self.levels.pop(), self.levels.pop())

    def _merge(self, a: tuple[int, str], b: tuple[int, str]) -> None:
        """Two levels of equal size become one; buckets stay where they are."""
        both = self._level(a[1]).unionByName(self._level(b[1]))
        name = self._write(both.withColumns({"what": F.lit(LEVEL), "matched": F.lit(False)}), "matched")
        for _, old in (a, b):
            if old in self.found:  # what the batch found is still needed
                remove_folder(self.spark, f"{self.folders[old]}/matched=false")
            else:
                self._drop(old)
        self.levels.append((a[0] + b[0], name))

    def rows(self, bit: int) -> DataFrame:
        """(key, row, lo, n) of all batches' rows with this bit of ``what``."""
        tables = [self.spark.table(t).where("matched").select("key", "row", "place", "what") for t in self.found]
        part = tables[0]
        for t in tables[1:]:
            part = part.unionByName(t)
        part = part.where(F.col("what").bitwiseAND(F.lit(bit)) > 0)
        low = F.col("place").bitwiseAND(F.lit((1 << 32) - 1))
        return part.select("key", "row", F.shiftright("place", 32).cast("int").alias("lo"), low.cast("int").alias("n"))

    def close(self) -> None:
        for name in list(self.folders):
            self._drop(name)


def save_bucketed(rows: DataFrame, buckets: int, key: str, *parts: str) -> tuple[str, str]:
    """Writes a table bucketed by ``key`` to the shared folder; (name in the catalog, folder).

    Rows that are already dealt to the buckets are not moved.
    """
    path = shared_path(rows.sparkSession)
    name = f"quarryline_{uuid.uuid4().hex}"
    writer = rows.write.format("parquet").bucketBy(buckets, key).sortBy(key)
    writer = writer.partitionBy(*parts) if parts else writer
    with settings(rows.sparkSession, CLEAN):
        writer.option("path", path).option("compression", "zstd").saveAsTable(name)
    return name, path


def _texts_of_runs(length: int):
    """(row, text, list of (key, lo, n, crowded)) to the bytes under the runs' windows, and crowded runs' windows.

    A crowded run comes as its windows, one row each under the window's own
    fingerprints; the others come whole under their key.
    """
    names = ["key", "row", "lo", "n", "bytes", "w"]
    kinds = [pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64()]

    def run(batches):
        out, heavy = [], 0
        for batch in batches:
            for row, text, runs in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), batch.column(2)):
                data, starts = text.as_py(), set()
                for r in runs.as_py():
                    lo, n = r["lo"], r["n"]
                    if r["crowded"]:
                        starts.update(range(lo, lo + n))
                    else:
                        out.append((r["key"], row, lo, n, data[lo : lo + n - 1 + length], None))
                        heavy += n + length
                every = np.array(sorted(starts), np.int64)
                for offset, piece in _segments(data, length, _SEGMENT) if starts else ():
                    own = every[(every >= offset) & (every <= offset + len(piece) - length)] - offset
                    if len(own):
                        h = Hashes(piece)
                        keys = h.stretch2(own, length).view(np.uint8).reshape(-1, 8)
                        rows = zip((own + offset).tolist(), h.stretch(own, length).tolist(), keys)
                        out += [(g.tobytes(), row, at, 1, None, w) for at, w, g in rows]
                        heavy += 100 * len(own)
                if heavy > 4 << 20:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                    out, heavy = [], 0
        if out:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return run


PIECES = "key binary, row bigint, lo int, n int, bytes binary, w bigint"


def _compare_bytes(length: int):
    """Runs sorted by (key, row, lo) to the windows that an earlier run of the key has: COVERS."""

    def run(batches):
        key, seen = None, {}
        for batch in batches:
            out = []
            for k, row, lo, n, data in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if k != key:
                    key, seen = k, {}
                start = None  # of a stretch of covered windows
                for i in range(n):
                    held = seen.setdefault(data[i : i + length], (row, lo + i)) != (row, lo + i)
                    if held and start is None:
                        start = i
                    elif not held and start is not None:
                        out.append((row, lo + start, i - start))
                        start = None
                if start is not None:
                    out.append((row, lo + start, n - start))
            if out:
                kinds = (pa.int64(), pa.int32(), pa.int32())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["row", "lo", "n"])

    return run


CUT = "digest binary, n_removed bigint, n_spans bigint, kept_sha256 string, span_starts array<bigint>, span_ends array<bigint>"


def _cut(length: int):
    """(digest, text, covered windows) to counts and the digest of what is left."""
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    names = [c.split()[0] for c in CUT.split(", ")]

    def run(batches):
        for batch in batches:
            out = []
            texts = batch.column(1).cast(pa.large_binary())
            for digest, text, runs in zip(batch.column(0).to_pylist(), texts, batch.column(2)):
                data, spans = text.as_py(), []
                for lo, n in sorted((r["lo"], r["n"]) for r in runs.as_py()):
                    hi = lo + n - 1 + length
                    if spans and lo <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], hi)
                    else:
                        spans.append([lo, hi])
                kept, at = hashlib.sha256(), 0
                for a, b in spans:
                    kept.update(data[at:a])
                    at = b
                kept.update(data[at:])
                starts, ends = [s[0] for s in spans], [s[1] for s in spans]
                out.append((digest, sum(ends) - sum(starts), len(spans), kept.hexdigest(), starts, ends))
            if out:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return run


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _number(slim: DataFrame, length: int, batches: int) -> DataFrame:
    """(digest, first_id, n_rows, row, batch) of the distinct texts, in the order of their first id.

    Null ids come last and equal ones go by the digest; only ids and digests are sorted.
    """
    order = ["first.none", "first.id", "digest"]
    firsts = slim.where(F.col("n_bytes") >= length).groupBy("digest")
    firsts = firsts.agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("first"), F.count("*").alias("n_rows"))
    count = slim.count()
    parts = batches * max(1, -(-count // (batches << 20)))
    ranged = firsts.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    named = stash(ranged.select("digest", F.col("first.id").alias("first_id"), "n_rows", F.monotonically_increasing_id().alias("row")))
    part = F.shiftright("row", 33)
    most = (named.agg(F.max(part)).first()[0] or 0) + 1
    return named.withColumn("batch", F.floor(part * batches / most).cast("int"))


def remove_repeats(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 100,
    batches: int | None = None,
    batch_bytes: int = 4 << 40,
    bucket_bytes: int = 256 << 20,
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, span_starts, span_ends) of every row.

    Documents come in the order of their ids, which may be of any type that can be
    sorted; null ids come after all others.  Different texts of one id, or of none, are
    different documents, in the order of their SHA-256.  Rows equal in id and text are
    one document, and each gets its result.  Null texts are empty; texts under
    ``length`` bytes lose nothing.  Other columns are not looked at.
    """
    if not GRAM <= length <= 200:
        raise ValueError("length must be from 32 to 200")
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).alias("id"), _digest(text).alias("digest"), text.alias("text"))
    slim = stash(own.select("id", "digest", F.octet_length("text").cast("long").alias("n_bytes")))
    total = slim.agg(F.sum("n_bytes")).first()[0] or 0
    batches = batches or max(_BATCHES, -(-total // batch_bytes))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // bucket_bytes))
    numbered = _number(slim, length, batches)
    index = SuffixIndex(spark, buckets, length)
    folder, held = None, None
    try:
        # One text a digest, dealt to buckets by it: copies are dropped before they move, and no later step moves texts.
        long = own.where(F.octet_length("text") >= length).groupBy("digest").agg(F.first("text").alias("text"))
        with settings(spark, {"spark.sql.shuffle.partitions": str(buckets), "spark.sql.adaptive.coalescePartitions.enabled": "false"}):
            held, folder = save_bucketed(long.join(numbered.select("digest", "row", "batch"), "digest"), buckets, "digest", "batch")
        texts = spark.table(held)
        for i in range(batches):
            index.add(texts.where(F.col("batch") == i), last=i == batches - 1)
        covers = index.rows(WHOLE).drop("key").unionByName(_compared(index, texts, numbered, length))
        spans = _by_digest(covers, numbered, buckets, F.collect_list(F.struct("lo", "n")))
        cut = stash(texts.join(spans, "digest").select("digest", "text", "runs").mapInArrow(_cut(length), CUT))
    finally:
        index.close()
        if held:
            spark.sql(f"DROP TABLE IF EXISTS {held}")
            remove_folder(spark, folder)
    return _answers(slim, numbered, cut, length)


def _by_digest(rows: DataFrame, numbered: DataFrame, buckets: int, runs: Column) -> DataFrame:
    """Rows gathered per text, dealt to the texts' buckets."""
    named = rows.join(numbered.select("row", "digest"), "row").repartition(buckets, "digest")
    return named.groupBy("digest").agg(runs.alias("runs"))


def _compared(index: SuffixIndex, texts: DataFrame, numbered: DataFrame, length: int) -> DataFrame:
    """COVERS of the runs that have to be compared by bytes or by their windows."""
    runs = index.rows(BYTES).withColumn("crowded", F.lit(False))
    runs = runs.unionByName(index.rows(WINDOWS).withColumn("crowded", F.lit(True)))
    runs = _by_digest(runs, numbered, index.buckets, F.collect_set(F.struct("key", "lo", "n", "crowded")))
    pieces = stash(texts.join(runs, "digest").select("row", "text", "runs").mapInArrow(_texts_of_runs(length), PIECES))
    whole = pieces.where("w is null").drop("w").repartition("key").sortWithinPartitions("key", "row", "lo")
    whole = whole.mapInArrow(_compare_bytes(length), COVERS)
    # A window's first place is kept; the aggregation combines a frequent window's rows before they move.
    windows = pieces.where("w is not null").select("key", "w", "row", "lo", "n")
    first = windows.groupBy("key", "w").agg(F.min(F.struct("row", "lo")).alias("first"), F.count("*").alias("places"))
    later = (F.col("row") != F.col("first.row")) | (F.col("lo") != F.col("first.lo"))
    crowded = windows.join(first.where("places > 1"), ["key", "w"]).where(later)
    return whole.unionByName(crowded.select("row", "lo", "n"))


def _answers(slim: DataFrame, numbered: DataFrame, cut: DataFrame, length: int) -> DataFrame:
    """Results of all rows: a text's first holder keeps what was cut of it, the others lose all."""
    short = F.col("n_bytes") < length
    rows = join_counted(slim.where(~short), numbered.select("digest", "first_id", "n_rows"), "digest", "n_rows")
    is_first = F.col("id").eqNullSafe(F.col("first_id"))
    none, nil = F.array().cast("array<bigint>"), F.lit(0).cast("long")

    def result(df, removed, spans, kept, starts, ends):
        names = ("n_removed", "n_spans", "kept_sha256", "span_starts", "span_ends")
        values = (removed, spans, kept, starts, ends)
        return df.select(F.col("id").alias("doc_id"), "n_bytes", *(v.alias(n) for n, v in zip(names, values)))

    whole = F.lower(F.hex("digest"))
    c = lambda name, untouched: F.coalesce(F.col(name), untouched)
    firsts = rows.where(is_first).join(cut, "digest", "left")
    firsts = result(firsts, c("n_removed", nil), c("n_spans", nil), c("kept_sha256", whole), c("span_starts", none), c("span_ends", none))
    empty = F.lit(hashlib.sha256().hexdigest())
    copies = result(rows.where(~is_first), F.col("n_bytes"), F.lit(1).cast("long"), empty, F.array(nil), F.array("n_bytes"))
    return firsts.unionByName(copies).unionByName(result(slim.where(short), nil, nil, whole, none, none))
