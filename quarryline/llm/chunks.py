"""Documents in chunks: rows of bounded size whose number stays the same, so that what other tasks find out comes back to them."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import settings, stash

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def stash_in_batches(df: DataFrame, rows: int) -> DataFrame:
    """``stash`` of chunks, with so many rows at most on their way to a worker at once."""
    with settings(df.sparkSession, {BATCH: str(rows)}):
        return stash(df, wide=True)


def packer(chunk_bytes: int):
    """Batches (id, text) to rows (chunk, n_bytes, ids, texts)."""

    def packed(batches):
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def chunk():
            columns = [pa.concat_arrays([b.column(i) for b in held]) for i in range(2)]
            ends = pa.array([0, len(columns[0])], pa.int32())
            rows = [pa.ListArray.from_arrays(ends, c) for c in columns]
            return pa.record_batch([pa.array([number]), pa.array([size]), *rows], ["chunk", "n_bytes", "ids", "texts"])

        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            start = 0
            for i, n in enumerate(lengths):
                if size and size + n > chunk_bytes:
                    held.append(batch.slice(start, i - start))
                    yield chunk()
                    number, held, size, start = number + 1, [], 0, i
                size += n
            held.append(batch.slice(start))
        if sum(map(len, held)):
            yield chunk()

    return packed


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) of documents, texts as bytes; null texts are empty."""
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("text"))


def chunked(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int) -> DataFrame:
    """(chunk, n_bytes, ids, texts) of documents, written to the shared folder.

    A chunk holds ``chunk_bytes`` of text at most, or one longer document.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    packed = keyed(docs, id_col, text_col).mapInArrow(packer(chunk_bytes), f"chunk bigint, n_bytes bigint, ids array<{kind}>, texts array<binary>")
    return stash_in_batches(packed, 512)
