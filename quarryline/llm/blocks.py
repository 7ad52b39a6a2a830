"""Removal of word passages that stand in more than one place, by anchors in fixed blocks.

A word goes if a window of ``window`` (35) words over it also starts anywhere else, in
another document or the same one; all places of a passage go, the first too.

Each document is cut into blocks of ``(window + 1) // 2`` words side by side, so that
every window holds a whole block: its anchor is the first.  The blocks are the index.
Every run of as many words, at every place, is a probe.  Both go, as fingerprints in
buckets, to the same tasks: a block that is probed from a second place is hit.  A window
can only repeat if its anchor is hit, so what is extended are the hits: the windows round
each are told apart by longer fingerprints, counted over the corpus, and those with two
places or more join up to the maximal repeats.

Nothing grows with the square of a group.  Documents are read in chunks of bounded size
(``chunks``).  A chunk sends each fingerprint to a bucket once, however often it occurs
there, and gets one bit for it back; so a bucket holds at most a fingerprint a chunk, and
a key of a third of all rows takes no more room than others.  Buckets are as many as the
text needs (``bucket_bytes``).

Fingerprints: probes have 32 bits and the bucket's; one that meets another by chance only
makes windows be counted for nothing.  Windows are equal if 64 bits, the bucket's own, and
the words' 64 bits agree; of 10^13 windows to be counted some one differs from its equal.

Odd rows: null and empty texts have no words; texts of fewer words than a window lose
nothing.  Rows with one id, or none, are documents of their own, and equal rows repeat each
other.  Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.chunks import chunked, stash_in_batches

#: For executors with 1 GB a core.  A bucket gets about CHUNK_BYTES * BUCKET_BYTES / (6 * all bytes) fingerprints
#: of a chunk in one row; 64 MB and 256 MB (some 3 GB a core) keep that above 20 at 100 TB.
CHUNK_BYTES = 2 << 20
BUCKET_BYTES = 8 << 20
SENT = "bucket int, chunk bigint, keys binary, many binary, ours binary"
BITS = "chunk bigint, bucket int, bits binary"


_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def _factors(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    """Spreads what differs in few bits over all of them."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64 bits of every word of the texts, one text after another, and the number of words of each text."""
    data = np.frombuffer(b" ".join(texts) + bytes(8), np.uint8)
    n = len(data) - 8
    inside = ~_BLANK[data[:n]]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, size = edge[::2], edge[1::2] - edge[::2]
    eight = np.empty(n, np.uint64)  # the eight bytes from each place on
    for i in range(min(8, n)):
        eight[i::8] = np.frombuffer(data.data, "<u8", (n - i + 7) // 8, i)
    h, left, open_ = size.astype(np.uint64), size, np.arange(len(size))
    while len(open_):
        part = eight[start[open_] + (size[open_] - left)]
        short = np.clip(8 - left, 0, 7).astype(np.uint64) * np.uint64(8)
        h[open_] = _mixed((h[open_] ^ (part << short)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
        more = left > 8
        open_, left = open_[more], left[more] - 8
    docs = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return h, np.diff(np.searchsorted(start, docs))


class Chunk:
    """The words of a chunk's documents, one after another, as hashes."""

    def __init__(self, texts: list[bytes]):
        self.words, self.sizes = word_hashes(texts)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes

    def _spread(self, per_doc: np.ndarray) -> np.ndarray:
        """A document's value, for each of its words."""
        return np.repeat(per_doc, self.sizes)

    def probes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, fingerprints) of all runs of ``size`` words inside documents."""
        n = len(self.words) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = np.zeros(n, np.uint64)
        for j, c in enumerate(_factors(size, 1)):
            h += self.words[j : j + n] * c
        at = np.flatnonzero(np.arange(n) + size <= self._spread(self.ends)[:n])
        return at, _mixed(h[at])

    def is_block(self, at: np.ndarray, size: int) -> np.ndarray:
        return (at - self._spread(self.starts)[at]) % size == 0

    def windows_round(self, blocks: np.ndarray, size: int, window: int) -> np.ndarray:
        """First words of the windows whose anchor is one of these blocks."""
        at = (blocks[:, None] - np.arange(size)).ravel()
        lo, hi = np.repeat(self._spread(self.starts)[blocks], size), np.repeat(self._spread(self.ends)[blocks], size)
        return at[(at >= lo) & (at + window <= hi)]

    def window_hashes(self, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        h, other = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
        for j, (c, d) in enumerate(zip(_factors(window, 2), _factors(window, 3))):
            w = self.words[at + j]
            h += w * c
            other += (w ^ w >> np.uint64(32)) * d
        return _mixed(h), _mixed(other)

    def covered(self, at: np.ndarray, window: int) -> np.ndarray:
        """Words under windows that start at these places."""
        edge = np.zeros(len(self.words) + window, np.int32)
        edge[at] += 1
        edge[at + window] -= 1
        return np.cumsum(edge)[: len(self.words)] > 0


def _buckets(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


class Keys:
    """Distinct fingerprints in the order of bucket and value, and where each of the given ones stands among them."""

    def __init__(self, bucket: np.ndarray, value: np.ndarray):
        if value.itemsize == 4:
            order = np.argsort(bucket.astype(np.uint64) << np.uint64(32) | value)
        else:
            order = np.argsort(value)
            order = order[np.argsort(bucket[order], kind="stable")]
        b, v = bucket[order], value[order]
        first = np.ones(len(b), bool)
        first[1:] = (b[1:] != b[:-1]) | (v[1:] != v[:-1])
        self.place = np.empty(len(b), np.int64)
        self.place[order] = np.cumsum(first) - 1
        at = np.flatnonzero(first)
        self.bucket, self.value = b[at], v[at]
        self.many = np.diff(np.append(at, len(b))) > 1

    def sent(self, chunk: int, ours: np.ndarray) -> pa.RecordBatch:
        """A row for each bucket: values by rising distance, byte by byte; which occur more than once; which are marked."""
        edge = np.flatnonzero(np.diff(self.bucket, prepend=-1))
        rows = []
        for lo, hi in zip(edge, np.append(edge[1:], len(self.bucket))):
            steps = np.diff(self.value[lo:hi], prepend=self.value.dtype.type(0))
            planes = np.ascontiguousarray(steps.view(np.uint8).reshape(hi - lo, -1).T)
            rows.append((int(self.bucket[lo]), chunk, planes.tobytes(), np.packbits(self.many[lo:hi]).tobytes(), np.packbits(ours[lo:hi]).tobytes()))
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["bucket", "chunk", "keys", "many", "ours"])

    def returned(self, bits: list[dict]) -> np.ndarray:
        """The bit that came back for each distinct fingerprint; buckets that sent nothing back say no."""
        out = np.zeros(len(self.bucket), bool)
        for part in bits:
            lo, hi = np.searchsorted(self.bucket, [part["bucket"], part["bucket"] + 1])
            out[lo:hi] = np.unpackbits(np.frombuffer(part["bits"], np.uint8), count=hi - lo)
        return out


def _matcher(width: type):
    """Fingerprints of a bucket that are marked somewhere and occur twice or more; a bit for each, by chunk."""
    size = np.dtype(width).itemsize

    def match(rows: pa.Table) -> pa.Table:
        parts = []
        for keys, many, ours in zip(*(rows[c].to_pylist() for c in ("keys", "many", "ours"))):
            planes = np.frombuffer(keys, np.uint8).reshape(size, -1)
            value = np.cumsum(np.ascontiguousarray(planes.T).view(width).ravel(), dtype=width)
            flags = (np.unpackbits(np.frombuffer(b, np.uint8), count=len(value)) for b in (many, ours))
            parts.append((value, *flags))
        values = np.concatenate([p[0] for p in parts])
        unique, place = np.unique(values, return_inverse=True)
        times = np.bincount(place, minlength=len(unique)) + np.bincount(place[np.concatenate([p[1] for p in parts]) > 0], minlength=len(unique))
        marked = np.zeros(len(unique), bool)
        marked[place[np.concatenate([p[2] for p in parts]) > 0]] = True
        hit, at, out = ((times > 1) & marked)[place], 0, []
        for (value, _, _), chunk in zip(parts, rows["chunk"].to_pylist()):
            own = hit[at : at + len(value)]
            at += len(value)
            if own.any():
                out.append((chunk, rows["bucket"][0].as_py(), np.packbits(own).tobytes()))
        kinds = (pa.int64(), pa.int32(), pa.binary())
        columns = zip(*out) if out else ((),) * 3
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], ["chunk", "bucket", "bits"])

    return match


class _Plan:
    """The steps of a chunk's tasks, for one setting."""

    def __init__(self, window: int, buckets: int):
        self.window, self.size, self.buckets = window, (window + 1) // 2, buckets

    def block_keys(self, chunk: Chunk) -> tuple[Keys, np.ndarray, np.ndarray]:
        """Keys of all probes, their places, and which of them are blocks."""
        at, h = chunk.probes(self.size)
        keys = Keys(_buckets(h, self.buckets), (h & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        return keys, at, chunk.is_block(at, self.size)

    def window_keys(self, chunk: Chunk, hits: list[dict]) -> tuple[Keys, np.ndarray]:
        """Keys and first words of the windows round the blocks that were hit."""
        keys, at, block = self.block_keys(chunk)
        windows = chunk.windows_round(at[block & keys.returned(hits)[keys.place]], self.size, self.window)
        h, other = chunk.window_hashes(windows, self.window)
        return Keys(_buckets(other, self.buckets), h), windows

    def probe(self, batches):
        for batch in batches:
            for number, texts in zip(batch["chunk"].to_pylist(), batch["texts"]):
                keys, _, block = self.block_keys(Chunk(texts.as_py()))
                if len(keys.bucket):
                    ours = np.zeros(len(keys.bucket), bool)
                    ours[keys.place[block]] = True
                    yield keys.sent(number, ours)

    def extend(self, batches):
        for batch in batches:
            for number, texts, hits in zip(batch["chunk"].to_pylist(), batch["texts"], batch["hits"]):
                keys, _ = self.window_keys(Chunk(texts.as_py()), hits.as_py())
                if len(keys.bucket):
                    yield keys.sent(number, np.ones(len(keys.bucket), bool))

    def remove(self, batches):
        for batch in batches:
            for ids, texts, hits, repeats in zip(*(batch[c] for c in ("ids", "texts", "hits", "repeats"))):
                yield self._removed(ids.values, texts.as_py(), hits.as_py(), repeats.as_py())

    def _removed(self, ids: pa.Array, texts: list[bytes], hits: list[dict] | None, repeats: list[dict] | None) -> pa.RecordBatch:
        gone = None
        if repeats:
            chunk = Chunk(texts)
            keys, windows = self.window_keys(chunk, hits)
            gone = chunk.covered(windows[keys.returned(repeats)[keys.place]], self.window)
        rows, at = [], 0
        for text in texts:
            words = text.split()
            own = gone[at : at + len(words)] if gone is not None else np.zeros(0, bool)
            at += len(words)
            edge = np.flatnonzero(np.diff(own, prepend=False, append=False))
            kept = b" ".join(compress(words, ~own) if len(edge) else words)
            rows.append((len(words), int(own.sum()), edge[::2].tolist(), edge[1::2].tolist(), hashlib.sha256(kept).hexdigest()))
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string())
        names = ["id", "n_words", "n_removed", "span_starts", "span_ends", "kept_sha256"]
        return pa.record_batch([ids, *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], names)


def _come_back(sent: DataFrame, width: type, name: str) -> DataFrame:
    """(chunk, name): the bits of a chunk's fingerprints, by bucket."""
    bits = sent.groupBy("bucket").applyInArrow(_matcher(width), BITS)
    return bits.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias(name))  # a row for each bucket of a chunk


def remove_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 35, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Per document: its id, n_words, n_removed, span_starts and span_ends of the removed runs of words, kept_sha256."""
    if window < 2:
        raise ValueError("a window takes two words at least")
    spark = docs.sparkSession
    texts = chunked(docs, id_col, text_col, chunk_bytes)
    total = texts.agg(F.sum("n_bytes")).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    plan = _Plan(window, max(4 * parts, -(-total // bucket_bytes)))
    hits = stash_in_batches(_come_back(texts.select("chunk", "texts").mapInArrow(plan.probe, SENT), np.uint32, "hits"), 4)
    open_ = texts.select("chunk", "texts").join(hits, "chunk")
    repeats = stash_in_batches(_come_back(open_.mapInArrow(plan.extend, SENT), np.uint64, "repeats"), 4)
    known = repeats.join(hits, "chunk")
    kind = docs.schema[id_col].dataType.simpleString()
    result = f"{{}} {kind}, n_words bigint, n_removed bigint, span_starts array<bigint>, span_ends array<bigint>, kept_sha256 string"
    found = texts.join(known, "chunk", "left").mapInArrow(plan.remove, result.format("id"))
    return found.withColumnRenamed("id", id_col)
