"""Fill-in-the-middle texts, assembled by a secondary sort.

A text of ``n`` units (a run of ASCII letters, or any other single code point) is cut
in two places that digests of its id choose.  Its three parts go out as pieces of at
most ``piece`` code points, keyed by the document's row and their place in the output.
One shuffle deals the rows out and sorts them within its partitions
(``repartition`` and ``sortWithinPartitions``, which is what the RDD operation
repartitionAndSortWithinPartitions is called on tables), so that a task reads each
output as a stream of pieces into an incremental digest.  What it passes on is sorted
once more inside the partitions, without a shuffle, into the order of the original
text, and streamed into the digest of what was restored.  Where a piece belongs is
told from the markers met in the output and from its form alone.  No step holds more
of a document than a piece, but for the cutter, which reads the row it is given.

Odd rows: a null text is empty, a null id is the empty string in the digest that
chooses the cuts; empty texts stay plain.  Rows with one id or one text are documents
of their own.  Bytes that are not UTF-8 become U+FFFD.  Other columns are not looked
at.  Rows are numbered as they are read: what does not come from files should be
written first, so that a lost task finds its rows in the same order.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
#: Parts of a text in its own order, by the marker that leads them in the output.
PART = {"": 0, PREFIX: 0, MIDDLE: 1, SUFFIX: 2}
END = 3
PLAIN_SHARE, SPM_SHARE = 90, 20
_SLICE = 1 << 20

_ABOUT = [("form", pa.string()), ("n", pa.int64()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())]
_PIECE = [("row", pa.int64()), ("place", pa.int32()), ("mark", pa.string()), ("body", pa.string())]
_PART = [("row", pa.int64()), ("part", pa.int32()), ("no", pa.int32()), ("body", pa.string())]
_DONE = [("output_sha256", pa.string()), ("output", pa.string())]
_RESTORED = [("restored_sha256", pa.string())]


def _ddl(fields: list, id_type: str) -> str:
    names = {pa.int64(): "bigint", pa.int32(): "int", pa.string(): "string", None: id_type}
    return ", ".join(f"{name} {names[kind]}" for name, kind in fields)


def _batch(rows: list[tuple], fields: list, id_type: pa.DataType) -> pa.RecordBatch:
    """Rows as a batch; the id's column has the type that it came with."""
    arrays = [pa.array(c, kind or id_type) for c, (_, kind) in zip(zip(*rows), fields)]
    return pa.record_batch(arrays, [name for name, _ in fields])


_ID = [("id", None)]
_PIECES = _PIECE + _ID + _ABOUT
_PARTS = _PART + _ID + _ABOUT + _DONE
_RESULT = _ID + _ABOUT + _DONE + _RESTORED


def unit_starts(text: str, size: int = _SLICE):
    """Offsets at which units start, an array for each ``size`` code points."""
    inside = False
    for at in range(0, len(text), size):
        points = np.frombuffer(text[at : at + size].encode("utf-32-le"), np.uint32) | np.uint32(32)
        letter = (points >= ord("a")) & (points <= ord("z"))
        before = np.concatenate(([inside], letter[:-1]))
        yield at + np.flatnonzero(~(letter & before))
        inside = letter[-1]


def cut(text: str, one: int, other: int) -> tuple[int, int, int]:
    """(units, end of the prefix, end of the middle); the ends are offsets of code points."""
    n = sum(len(s) for s in unit_starts(text))
    wanted = sorted((one % (n + 1), other % (n + 1)))
    ends, seen = [], 0
    for starts in chain(unit_starts(text), [np.array([len(text)])]):
        ends += [int(starts[k - seen]) for k in wanted[len(ends) :] if k - seen < len(starts)]
        seen += len(starts)
    return n, *ends


def form_of(text: str, third: int, fourth: int) -> str:
    """plain, psm (prefix, suffix, middle) or spm (suffix, prefix, middle)."""
    if not text or third % 100 >= PLAIN_SHARE or any(m in text for m in MARKS):
        return "plain"
    return "spm" if fourth % 100 < SPM_SHARE else "psm"


def _cutter(piece: int):
    def pieces(batches):
        for batch in batches:
            out = []
            for row, key, name, text in zip(*(c.to_pylist() for c in batch.columns)):
                digest = hashlib.sha256(b"1:" + name.encode()).hexdigest()
                h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
                n, a, b = cut(text, h[0], h[1])
                form = form_of(text, h[2], h[3])
                spans = {PREFIX: (0, a), MIDDLE: (a, b), SUFFIX: (b, len(text)), "": (0, len(text))}
                order = {"plain": ("",), "psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}[form]
                sizes = (None, None) if form == "plain" else (a, b - a)
                place = 0
                for mark in order:
                    lo, hi = spans[mark]
                    for at in range(lo, max(hi, lo + 1), piece):
                        about = (key, form, n, *sizes) if place == 0 else (None,) * 5
                        out.append((row, place, mark if at == lo else "", text[at : min(at + piece, hi)], *about))
                        place += 1
            if out:
                yield _batch(out, _PIECES, batch.schema.field("id").type)

    return pieces


def pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", piece: int = 1 << 16) -> DataFrame:
    """The transformed documents: a document's output is its marks and bodies by place.

    (row, place, mark, body); the first piece of a row also tells its id, form, n,
    prefix_chars and middle_chars (null if plain).
    """
    if piece < 1:
        raise ValueError("a piece takes one code point at least")
    key = F.col(f"`{id_col}`")
    name, text = (F.coalesce(c.cast("string"), F.lit("")) for c in (key, F.col(f"`{text_col}`")))
    numbered = docs.select(
        F.monotonically_increasing_id().alias("row"), key.alias("id"), name.alias("name"), F.make_valid_utf8(text).alias("text")
    )
    return numbered.mapInArrow(_cutter(piece), _ddl(_PIECES, docs.schema[id_col].dataType.simpleString()))


def _read_output(with_text: bool):
    """Streams outputs into digests; passes the pieces on, keyed by their place in the text."""

    def parts(batches):
        row, about, digest, part, held, kind = None, None, None, 0, [], None
        silent = (None,) * (len(_ID + _ABOUT + _DONE))

        def closing():
            return (row, END, 0, None, *about, digest.hexdigest(), "".join(held) if with_text else None)

        for batch in batches:
            kind, out = batch.schema.field("id").type, []
            for r, place, mark, body, *first in zip(*(c.to_pylist() for c in batch.columns)):
                if r != row:
                    if row is not None:
                        out.append(closing())
                    row, about, digest, part, held = r, first, hashlib.sha256(), 0, []
                shown = mark + body
                digest.update(shown.encode())
                if with_text:
                    held.append(shown)
                part = PART[mark] if mark else part
                out.append((r, part, place, body, *silent))
            if out:
                yield _batch(out, _PARTS, kind)
        if row is not None:
            yield _batch([closing()], _PARTS, kind)

    return parts


def _restore(batches):
    """Streams the parts of each text, now in its own order, into the digest of what they make."""
    digest = hashlib.sha256()
    for batch in batches:
        out = []
        for _, part, _, body, *about in zip(*(c.to_pylist() for c in batch.columns)):
            if part == END:
                out.append((*about, digest.hexdigest()))
                digest = hashlib.sha256()
            else:
                digest.update(body.encode())
        if out:
            yield _batch(out, _RESULT, batch.schema.field("id").type)


def assemble(rows: DataFrame, *, partitions: int | None = None, with_text: bool = False) -> DataFrame:
    """Per document id, form, n, prefix_chars, middle_chars, output_sha256, restored_sha256, and its output ``with_text``.

    ``rows`` are pieces.  One shuffle by document; the second sort stays where the rows lie.
    """
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = rows.schema["id"].dataType.simpleString()
    output = rows.repartition(n, "row").sortWithinPartitions("row", "place")
    parts = output.mapInArrow(_read_output(with_text), _ddl(_PARTS, kind)).sortWithinPartitions("row", "part", "no")
    found = parts.mapInArrow(_restore, _ddl(_RESULT, kind))
    return found if with_text else found.drop("output")
