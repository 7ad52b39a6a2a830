"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.storage import CLEAN, keep, remove_folder, settings, shared_path

__all__ = ["CLEAN", "remove_folder", "settings", "shared_path"]

#: Words as the mixing, rule and SimHash operators see them: runs of anything but blanks.
SPACED_WORD = r"[^\x20\x09-\x0D]+"
#: Words as the licence and benchmark operators see them: runs of 0-9, a-z and non-ASCII.
PLAIN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once per row, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only.

    ``lower`` is right, and much faster than ``translate``, unless the text has
    a letter outside ASCII that has a lower-case form of its own.
    """
    other = text.rlike(r"[\x{80}-\x{10FFFF}&&[\p{Lu}\p{Lt}\p{Nl}\p{So}]]")
    return F.when(other, F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def stash(df: DataFrame, *, wide: bool = False) -> DataFrame:
    """Writes a table to the shared folder and reads it again; cuts the lineage."""
    return keep(df, wide=wide)


def trained_dictionary(samples: list[bytes], size: int) -> bytes:
    """A Zstandard dictionary of at most ``size`` bytes, and at most an eighth of its samples.

    Where whole samples are too few or too alike to train on, pieces of 64 bytes of them are
    trained on; a dictionary of 256 bytes is the smallest.  The bytes of samples that give
    none at all (under some 2 KB, or one string over and over) are a dictionary as they are.
    """
    pieces = [s[i : i + 64] for s in samples for i in range(0, len(s), 64)] if len(samples) < 1000 else []
    for held in (samples, pieces):
        most = min(size, sum(map(len, held)) // 8)
        while most >= 256:
            try:
                return zstandard.train_dictionary(most, held, k=min(256, most // 4), d=8, steps=4).as_bytes()
            except zstandard.ZstdError:
                most //= 2
    return b"".join(samples)[-size:]


def join_counted(rows: DataFrame, labels: DataFrame, key: str, count: str) -> DataFrame:
    """Inner join of rows with the label of their key; ``labels`` (key unique) has the number of rows a key has.

    Keys with over a fourth of a partition's share of the rows are at most four times as many as
    partitions.  Their labels, of bounded width, go to the tasks, so their rows are not dealt by the key.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    labels = stash(labels)
    most = max(32, (labels.agg(F.sum(count)).first()[0] or 0) // (4 * parts))
    hot = labels.where(F.col(count) > most).drop(count)
    there = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return there.unionByName(rest.join(labels.where(F.col(count) <= most).drop(count), key))


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents that no model may learn from."""
    return F.crc32(doc_id.cast("string")) % 5 == 0
