import os

import pyarrow as pa
import pyarrow.parquet as pq

from quarryline.llm.chunks import stash_in_batches


def test_rows_of_megabytes_are_written_and_read_a_few_at_a_time(spark):
    def wide(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                yield pa.record_batch([pa.array([i]), pa.array([os.urandom(1 << 20)], pa.binary())], ["chunk", "a"])

    kept = stash_in_batches(spark.range(0, 60, 1, 1).mapInArrow(wide, "chunk bigint, a binary"), 4)
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in kept.inputFiles()]
    groups = [m.row_group(i) for m in files for i in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 60 and kept.selectExpr("sum(chunk)", "sum(length(a))").first()[:] == (1770, 60 << 20)
    # What a writer holds, and what a reader takes at once, does not grow with a task's rows.
    assert max(g.total_byte_size for g in groups) <= 18 << 20
