"""Alignment of two tokenizers' tokens, in Arrow tables.

A text (with a space before it) is encoded by A, a byte-level BPE, and by B, a BPE of
pieces.  Tokens are bytes, so both cut the text's bytes, and an A and a B token are linked
wherever their bytes overlap.  The offsets where both end cut the tokens into groups.

Documents are encoded once, in chunks of bounded size, and their packed ids are written.
Inside a chunk all work is on columns: token lists are flattened with their parents'
numbers, lengths are summed up within each document to end offsets, and the ends of both
sides meet in a hash join on (document, end), whose rows are the ends of groups.  A
chunk's links are counted by id pair (``Table.group_by``); Spark sums these partial
counts over the corpus and finds the highest count of each B id.  Each chunk then gets
the counts of its own pairs back, by a grouping of both on its number.

The only table sent to all tasks is the highest count by B id, one row for each entry of
B's vocabulary at most.  Vocabularies are read by the driver and sent as bytes.

Odd rows: null and empty texts, texts that are not UTF-8, and texts that a tokenizer does
not give back byte by byte have no tokens: zeros, and '' for the groups.  Rows with one id
are documents of their own.  Names of special tokens in a text are plain text.  Other
columns are not looked at.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
import tokenizers
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.chunks import keyed, packer, stash_in_batches
from quarryline.llm.common import stash

CHUNK_BYTES = 4 << 20
#: Tokens of A that are laid out at once.
SLICE_TOKENS = 1 << 17
#: Fixed value: how the byte-level BPE splits a text before its merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Blank runs from here on overflow the fast encoder's pattern.
_LONG_RUN = 50_000


@dataclass(frozen=True)
class Tokenizers:
    """Both tokenizers, from the bytes of their files."""

    a_file: bytes
    b_file: bytes

    @staticmethod
    def read(a_path: str, b_path: str) -> Tokenizers:
        with open(a_path, "rb") as a, open(b_path, "rb") as b:
            return Tokenizers(a.read(), b.read())

    @cached_property
    def a_entries(self) -> dict[bytes, int]:
        """Bytes of A's entries without its special ones; printable bytes stand for themselves, others are shifted."""
        spec = json.loads(self.a_file)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = sorted(set(range(256)) - set(plain))
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        special = {t["content"] for t in spec["added_tokens"]}
        return {bytes(byte[c] for c in e): i for e, i in spec["model"]["vocab"].items() if e not in special}

    @cached_property
    def a_bytes(self) -> pa.Array:
        held = {i: e for e, i in self.a_entries.items()}
        return pa.array([held.get(i, b"") for i in range(max(held) + 1)], pa.binary())

    @cached_property
    def b_bytes(self) -> pa.Array:
        model, out = self._b, []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            whole = bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()
            out.append(b"" if model.is_control(i) or model.is_unknown(i) else whole)
        return pa.array(out, pa.binary())

    @cached_property
    def width(self) -> str:
        """How an id is packed."""
        return "<u2" if max(len(self.a_bytes), len(self.b_bytes)) <= 1 << 16 else "<u4"

    @cached_property
    def _a(self) -> tiktoken.Encoding:
        return tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks=self.a_entries, special_tokens={})

    @cached_property
    def _a_slow(self) -> tokenizers.Tokenizer:
        slow = tokenizers.Tokenizer.from_str(self.a_file.decode())
        slow.encode_special_tokens = True
        return slow

    @cached_property
    def _b(self) -> sentencepiece.SentencePieceProcessor:
        return sentencepiece.SentencePieceProcessor(model_proto=self.b_file)

    def encode_a(self, text: str) -> np.ndarray:
        if len(text) >= _LONG_RUN and re.search(rf"\s{{{_LONG_RUN}}}", text):
            return np.array(self._a_slow.encode(text, add_special_tokens=False).ids, np.int32)
        return self._a.encode_to_numpy(text, disallowed_special=()).astype(np.int32)

    def encode_b(self, text: str) -> np.ndarray:
        return np.array(self._b.encode(text, num_threads=1), np.int32)

    def __reduce__(self):
        return Tokenizers, (self.a_file, self.b_file)


@lru_cache(1)
def _loaded(held: Tokenizers) -> Tokenizers:
    """One set of tokenizers for all tasks of a worker."""
    return held


def _encoder(sent, chunk_bytes: int):
    def encoded(batches):
        t = _loaded(sent.value)
        for batch in packer(chunk_bytes)(batches):
            for number, ids, texts in zip(batch["chunk"].to_pylist(), batch["ids"], batch["texts"]):
                yield _encoded_chunk(t, number, ids.values, texts.as_py())

    return encoded


def _joined(table: pa.Array, ids: np.ndarray) -> bytes:
    """The bytes of a text's tokens."""
    taken = table.take(pa.array(ids))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), taken), b"")[0].as_py()


_COUNTED = ["n_a", "n_b", "n_groups", "n_links"]


def _encoded_chunk(t: Tokenizers, number: int, ids: pa.Array, texts: list[bytes]) -> pa.RecordBatch:
    sides: tuple[list, list] = ([], [])
    for text in texts:
        try:
            plain = text.decode()
        except UnicodeDecodeError:
            plain = ""
        pair = (t.encode_a(" " + plain), t.encode_b(plain)) if plain else ()
        kept = pair and all(_joined(table, x) == b" " + text for x, table in zip(pair, (t.a_bytes, t.b_bytes)))
        for side, x in zip(sides, pair if kept else (np.zeros(0, np.int32),) * 2):
            side.append(x)
    a, b = (pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]), pa.int32()), pa.array(np.concatenate(x))) for x in sides)
    counts, digests, pairs = [], [], []
    for _, _, layout in _slices(t, a, b):
        counts.append(layout.counts())
        digests += layout.digests()
        pairs.append(layout.pairs())
    found = pa.concat_tables(pairs).group_by(["a", "b"], use_threads=False).aggregate([("n", "sum")]).rename_columns(["a", "b", "n"])
    pairs_row = pa.StructArray.from_arrays([found[c].combine_chunks() for c in ("a", "b", "n")], ["a", "b", "n"])
    rows = [ids, *(pa.array(c, pa.int64()) for c in np.concatenate(counts, axis=1)), pa.array(digests, pa.string()), pairs_row]
    held = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in rows]
    pack = zstandard.ZstdCompressor(level=1).compress
    packed = [pa.array([pack(np.concatenate(x).astype(t.width).tobytes())], pa.binary()) for x in sides]
    return pa.record_batch([pa.array([number]), *packed, *held], ["chunk", "a", "b", "ids", *_COUNTED, "groups_sha256", "pairs"])


def _unpacked(t: Tokenizers, ids: bytes, sizes: pa.Array) -> pa.ListArray:
    """Lists of token ids by document."""
    ends = np.concatenate(([0], np.cumsum(sizes.to_numpy())))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(zstandard.decompress(ids), t.width).astype(np.int32)))


def _places(tokens: pa.Array, table: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, end offset inside it, end offset in all documents one after another) of each token."""
    flat, doc = pc.list_flatten(tokens), pc.list_parent_indices(tokens).to_numpy()
    running = np.cumsum(pc.binary_length(table.take(flat)).to_numpy(), dtype=np.int64)
    edge = np.searchsorted(doc, np.arange(len(tokens)))
    base = np.concatenate(([0], running))[edge]
    return doc, running - base[doc], running


class Layout:
    """Groups and links of some documents' tokens (``a`` and ``b``: lists of ids by document)."""

    def __init__(self, t: Tokenizers, a: pa.Array, b: pa.Array):
        self.n_docs = len(a)
        self.a, self.b = pc.list_flatten(a).to_numpy(), pc.list_flatten(b).to_numpy()
        self.a_doc, self.a_end, a_run = _places(a, t.a_bytes)
        self.b_doc, self.b_end, b_run = _places(b, t.b_bytes)
        # A stretch of bytes between neighbouring ends of either side is in one A and one B token: a link.
        both = np.concatenate((a_run, b_run))
        order = np.argsort(both, kind="stable")  # two runs that are in order already
        end, is_a = both[order], order < len(a_run)
        at = np.flatnonzero(np.diff(end, prepend=-1))
        ends_a = np.add.reduceat(is_a, at, dtype=np.int64) if len(at) else at
        ends_b = np.add.reduceat(~is_a, at, dtype=np.int64) if len(at) else at
        in_a, in_b = np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b
        self.link_doc, self.link_a, self.link_b = self.a_doc[in_a], self.a[in_a], self.b[in_b]

    @cached_property
    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        """Last A and last B token of each group: where both sides have an end at one (document, end)."""
        a = pa.table({"doc": self.a_doc, "end": self.a_end, "a": np.arange(len(self.a))})
        b = pa.table({"doc": self.b_doc, "end": self.b_end, "b": np.arange(len(self.b))})
        both = a.join(b, ["doc", "end"], join_type="inner", use_threads=False)
        return np.sort(both["a"].to_numpy()), np.sort(both["b"].to_numpy())

    def pairs(self) -> pa.Table:
        """(a, b, n): how often each id pair is linked here."""
        links = pa.table({"a": self.link_a, "b": self.link_b})
        return links.group_by(["a", "b"], use_threads=False).aggregate([([], "count_all")]).rename_columns(["a", "b", "n"])

    def counts(self) -> np.ndarray:
        """Rows of n_a, n_b, n_groups, n_links, a column for each document."""
        docs = (self.a_doc, self.b_doc, self.a_doc[self.groups[0]], self.link_doc)
        return np.stack([np.bincount(d, minlength=self.n_docs) for d in docs])

    def sums(self, value: np.ndarray) -> np.ndarray:
        """Sums of the links' values by document."""
        running = np.concatenate(([0], np.cumsum(value, dtype=np.int64)))
        edge = np.searchsorted(self.link_doc, np.arange(self.n_docs + 1))
        return running[edge[1:]] - running[edge[:-1]]

    def digests(self) -> list[str]:
        """By document, the SHA-256 of its groups as ``a1,a2|b1;a3|b2``; '' without tokens."""
        a_last, b_last = self.groups
        b_first = np.concatenate(([0], b_last + 1))
        shown, mark = (np.empty(len(self.a) + len(self.b), np.int32) for _ in range(2))
        for ids, last, side in ((self.a, a_last, 0), (self.b, b_last, 1)):
            at = np.arange(len(ids))
            group = np.searchsorted(last, at)
            place = at + (a_last[group] + 1 if side else b_first[group])
            ended = np.zeros(len(ids), np.int32)
            ended[last] = 1 + side
            if side:
                ended[np.flatnonzero(np.diff(self.b_doc, append=-1))] = 3
            shown[place], mark[place] = ids, ended
        marks = pa.array([",", "|", ";", ""]).take(pa.array(mark))
        text = pc.binary_join_element_wise(pa.array(shown).cast(pa.string()), marks, "")
        edge = sum(np.searchsorted(d, np.arange(self.n_docs + 1)) for d in (self.a_doc, self.b_doc))
        whole = pc.binary_join(pa.ListArray.from_arrays(pa.array(edge, pa.int32()), text), "").to_pylist()
        return [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in whole]


def _slices(t: Tokenizers, a: pa.Array, b: pa.Array):
    """(first, end, layout) of runs of documents of about SLICE_TOKENS tokens."""
    cut = np.cumsum(pc.list_value_length(a).to_numpy()) // SLICE_TOKENS
    edge = [*np.flatnonzero(np.diff(cut, prepend=-1)), len(a)]
    for lo, hi in zip(edge[:-1], edge[1:]):
        yield lo, hi, Layout(t, a.slice(lo, hi - lo), b.slice(lo, hi - lo))


def _finisher(sent):
    """A chunk's documents, with the counts of its pairs (a, b, n, best)."""

    def finished(encoded: pa.Table, counts: pa.Table) -> pa.Table:
        t = _loaded(sent.value)
        code = counts["a"].to_numpy().astype(np.int64) << 32 | counts["b"].to_numpy()
        order = np.argsort(code)
        code, n, best = code[order], counts["n"].to_numpy()[order], counts["best"].to_numpy()[order]
        out = []
        for row in range(len(encoded)):
            held = {c: encoded[c][row].values for c in ("ids", *_COUNTED, "groups_sha256")}
            a, b = (_unpacked(t, encoded[c][row].as_py(), held[f"n_{c}"]) for c in ("a", "b"))
            sums: tuple[list, list] = ([], [])
            for _, _, layout in _slices(t, a, b):
                at = np.searchsorted(code, layout.link_a.astype(np.int64) << 32 | layout.link_b)
                for side, value in zip(sums, (best, n)):
                    side.append(layout.sums(value[at]))
            known = [held[c] for c in ("ids", *_COUNTED)]
            columns = [*known, *(pa.array(np.concatenate(x), pa.int64()) for x in sums), held["groups_sha256"]]
            out.append(pa.table(columns, ["id", *_COUNTED, "n_best", "count_sum", "groups_sha256"]))
        return pa.concat_tables(out)

    return finished


def encode(docs: DataFrame, held: Tokenizers, *, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Documents by chunk, written to the shared folder.

    (chunk, a, b, ids, n_a, n_b, n_groups, n_links, groups_sha256, pairs): all token ids of a chunk, packed, and lists
    with an entry for each document; ``pairs`` counts the chunk's links by id pair.
    """
    sent = docs.sparkSession.sparkContext.broadcast(held)
    kind = docs.schema[id_col].dataType.simpleString()
    counted = ", ".join(f"{c} array<bigint>" for c in _COUNTED)
    schema = f"chunk bigint, a binary, b binary, ids array<{kind}>, {counted}, groups_sha256 array<string>, pairs array<struct<a:int,b:int,n:bigint>>"
    return stash_in_batches(keyed(docs, id_col, text_col).mapInArrow(_encoder(sent, chunk_bytes), schema), 512)


def pair_counts(encoded: DataFrame) -> DataFrame:
    """(chunk, a, b, n, best): of each chunk's id pairs, the links of the whole corpus, and whether B's id has no pair with more."""
    partial = encoded.select("chunk", F.inline("pairs"))
    total = stash(partial.groupBy("a", "b").agg(F.sum("n").alias("n")))
    most = total.groupBy("b").agg(F.max("n").alias("most"))  # a row for each entry of B's vocabulary
    ranked = total.join(F.broadcast(most), "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))
    return partial.select("chunk", "a", "b").join(ranked, ["a", "b"])


def align(docs: DataFrame, held: Tokenizers, *, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per document its id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    encoded = encode(docs, held, id_col=id_col, text_col=text_col, chunk_bytes=chunk_bytes)
    sent = docs.sparkSession.sparkContext.broadcast(held)
    kind = docs.schema[id_col].dataType.simpleString()
    result = ", ".join([f"id {kind}", *(f"{c} bigint" for c in (*_COUNTED, "n_best", "count_sum")), "groups_sha256 string"])
    counts = pair_counts(encoded).withColumnRenamed("chunk", "of")
    chunks = encoded.drop("pairs").groupBy("chunk").cogroup(counts.groupBy("of"))
    return chunks.applyInArrow(_finisher(sent), result).withColumnRenamed("id", id_col)
