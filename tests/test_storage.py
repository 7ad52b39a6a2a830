"""What steps leave on disk."""

import time

from pyspark.sql import functions as F

from quarryline.storage import _made, keep, passing, shared_path


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_kept_step_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    kept = keep(spark.range(10000).groupBy((F.col("id") % 100).alias("k")).agg(F.sum("id").alias("n")))
    for _ in range(50):
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert kept.count() == 100


def test_steps_that_pass_leave_nothing_but_what_stays(spark, tmp_path):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    there = lambda p: path(p).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path(p))
    before = len(_made)
    with passing(spark) as stay:
        first = keep(spark.range(10))
        with passing(spark):
            inner = keep(first.where("id > 4"))
            kept = stay(inner.where("id > 6"))
        between = list(_made[before:])
        index = shared_path(spark)
    left = _made[before:]
    assert len(between) == 2 and len(left) == 2 and index in left
    assert not there(between[0]) and there(left[0]) and sorted(r[0] for r in kept.collect()) == [7, 8, 9]
