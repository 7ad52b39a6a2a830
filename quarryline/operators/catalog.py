"""Metadata questions: lists, statistics, inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.operators import selectors
from quarryline.operators.project import INDEX_VERSION
from quarryline.storage import keep


def list_sessions(sessions: DataFrame, *, sort: str = "ended", limit: int = 20, source_ids: list[str] | None = None, selector: dict | None = None, cwd: str | None = None, since: str | None = None) -> DataFrame:
    """Sessions by newest end, newest start or most messages; key order breaks ties."""
    s = sessions
    if source_ids:
        s = s.where(F.col("source_id").isin(*source_ids))
    if selector:
        s = s.where(selectors.matches(selectors.as_column(selector), F.col("source_id"), F.col("file_path"), F.col("cwd"), F.col("path_date")))
    if cwd:
        s = s.where(F.lower("cwd").contains(cwd.lower()))
    if since:
        s = s.where(F.col("ended_at") >= since)
    by = {"ended": "ended_at", "started": "started_at", "messages": "message_count"}[sort]
    return s.orderBy(F.desc(by), "session_key").limit(limit)


def source_stats(sessions: DataFrame) -> DataFrame:
    """Per source: sessions, messages, first start and last end."""
    return sessions.groupBy("source_id").agg(F.count("*").alias("session_count"), F.coalesce(F.sum("message_count"), F.lit(0)).alias("message_count"), F.min("started_at").alias("first_started_at"), F.max("ended_at").alias("last_ended_at"))


def stats_with_coverage(sessions: DataFrame, records: DataFrame) -> DataFrame:
    """The same with the number of current coverage proofs."""
    current = records.where(F.col("record_version") == INDEX_VERSION).groupBy(F.col("selector.source").alias("source_id"))
    n = current.agg(F.count("*").alias("coverage_records"))
    return source_stats(sessions).join(n, "source_id", "left").withColumn("coverage_records", F.coalesce("coverage_records", F.lit(0).cast("long")))


def top_cwds(sessions: DataFrame, n: int = 10) -> DataFrame:
    """Per source the working directories with most sessions."""
    counts = sessions.where("cwd <> ''").groupBy("source_id", "cwd").agg(F.count("*").alias("sessions"))
    w = Window.partitionBy("source_id").orderBy(F.desc("sessions"), "cwd")
    return counts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


_COUNTS = ("session_count", "message_count", "document_count")


def _places(sessions: DataFrame, roots: DataFrame) -> DataFrame:
    """Counts by (source, root, any_cwd, cwd, date) for the wanted roots (source, root) over each file; ``any_cwd`` is over all directories."""
    parts = F.split("file_path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    n = {"session_count": F.lit(1), "message_count": F.col("message_count"), "document_count": F.col("document_count")}
    each = sessions.select(F.col("source_id").alias("source"), F.explode(above).alias("root"), "cwd", F.col("path_date").alias("date"), *(F.coalesce(c, F.lit(0)).cast("long").alias(k) for k, c in n.items()))
    keyed = each.join(roots, ["source", "root"]).groupBy("source", "root", "cwd", "date").agg(*(F.sum(c).alias(c) for c in _COUNTS))
    scopes = F.explode(F.array(F.struct(F.lit(True).alias("any_cwd"), F.lit("").alias("cwd")), F.struct(F.lit(False).alias("any_cwd"), F.coalesce("cwd", F.lit("")).alias("cwd"))))
    both = keyed.withColumn("scope", scopes).drop("cwd").select("source", "root", "scope.any_cwd", "scope.cwd", "date", *_COUNTS)
    return both.groupBy("source", "root", "any_cwd", "cwd", "date").agg(*(F.sum(c).alias(c) for c in _COUNTS))


def selector_counts(sessions: DataFrame, wanted: DataFrame) -> DataFrame:
    """Sessions, messages and documents of each selector row (selector_id, s), by running sums over dates.

    A selector is answered by the sums at its two ends, so no step has a row for a selector
    and a session; what is ordered within a key are its dates and distinct ends.
    """
    key = ["source", "root", "any_cwd", "cwd"]
    dated = F.col("s.kind").isin("date_range", "cwd_date_range")
    placed = F.col("s.kind").isin("cwd", "cwd_date_range")
    w = wanted.select(
        "selector_id", F.col("s.source").alias("source"), F.col("s.root").alias("root"), (~placed).alias("any_cwd"), F.when(placed, F.coalesce("s.cwd", F.lit(""))).otherwise("").alias("cwd"),
        F.when(dated, F.col("s.fromDate")).alias("lo"), F.when(dated, F.col("s.toDate")).alias("hi"), dated.alias("dated"),
    )
    places = keep(_places(sessions, w.select("source", "root").distinct()))
    zero = [F.lit(0).cast("long").alias(c) for c in _COUNTS]
    ends = lambda c, side: w.where("dated").select(*key, F.col(c).alias("date"), F.lit(side).alias("side"), *zero).distinct()
    points = places.where("date is not null").withColumn("side", F.lit(1)).select(*key, "date", "side", *_COUNTS).unionByName(ends("lo", 0)).unionByName(ends("hi", 2))
    running = Window.partitionBy(*key).orderBy("date", "side")
    sums = points.select(*key, "date", "side", *(F.sum(c).over(running).alias(c) for c in _COUNTS))
    at = lambda side, name: sums.where(F.col("side") == side).select(*key, F.col("date").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in _COUNTS))
    ranged = w.where("dated").join(at(0, "lo"), [*key, "lo"]).join(at(2, "hi"), [*key, "hi"])
    ranged = ranged.select("selector_id", *(F.greatest(F.col(f"hi_{c}") - F.col(f"lo_{c}"), F.lit(0)).alias(c) for c in _COUNTS))
    whole = places.groupBy(*key).agg(*(F.sum(c).alias(c) for c in _COUNTS))
    plain = w.where("not dated").join(whole, key, "left").select("selector_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in _COUNTS))
    return ranged.unionByName(plain)


def inventory(files: DataFrame) -> DataFrame:
    """Files per working directory with their date range; ``place`` puts a source's directories in order, most files first."""
    order = Window.partitionBy("source_id").orderBy(F.desc("files"), "cwd")
    return _inventory(files).withColumn("place", F.row_number().over(order))


def _inventory(files: DataFrame) -> DataFrame:
    return files.groupBy("source_id", "cwd").agg(F.count("*").alias("files"), F.min("path_date").alias("from_date"), F.max("path_date").alias("to_date"))


def fingerprint_files(files: DataFrame, *, with_content: bool) -> DataFrame:
    """Digest per source and root of the file set, or of the files' state.

    Two levels: files of a directory in path order, then the directories' digests in
    order, so no list is longer than a directory or the number of directories.
    """
    part = F.col("file_path")
    if with_content:
        part = F.concat_ws("\x1f", "file_path", F.coalesce("path_date", F.lit("")), "cwd", F.coalesce("accepted_fingerprint", F.lit("")))
    folder = F.regexp_replace("file_path", "/[^/]*$", "")
    per_folder = files.groupBy("source_id", "source_root", folder.alias("folder")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list(part)), "\x1e"), 256).alias("d"))
    return per_folder.groupBy("source_id", "source_root").agg(F.sum("n").alias("file_count"), F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat_ws("\x1f", "folder", "d"))), "\x1e"), 256).alias("fingerprint"))


def file_set_digest(files: DataFrame, *, with_content: bool) -> DataFrame:
    """(source_id, source_root, file_count, d0 to d3): order-free digest per source and root of its files, or of their state.

    Each file's SHA-256 gives four numbers of 32 bits, which are summed up: no list of files is
    made, a row that comes twice counts twice, and a set's digest after a change follows from
    those of what went and what came (``digest_after``).
    """
    part = F.col("file_path")
    if with_content:
        part = F.concat_ws("\x1f", "file_path", F.coalesce("path_date", F.lit("")), F.coalesce("cwd", F.lit("")), F.coalesce("accepted_fingerprint", F.lit("")))
    h = files.select("source_id", "source_root", F.sha2(part, 256).alias("h"))
    words = (F.sum(F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("bigint")).alias(f"d{i}") for i in range(4))
    return h.groupBy("source_id", "source_root").agg(F.count("*").alias("file_count"), *words)


def digest_after(old: DataFrame, gone: DataFrame, come: DataFrame) -> DataFrame:
    """Digests of sets after a change, from the digests of what they were, what went and what came."""
    columns = ["file_count", *(f"d{i}" for i in range(4))]
    signed = old.unionByName(come).unionByName(gone.withColumns({c: -F.col(c) for c in columns}))
    return signed.groupBy("source_id", "source_root").agg(*(F.sum(c).alias(c) for c in columns))


def digest_text() -> Column:
    return F.concat_ws(":", F.lit("set-v1"), "file_count", *(F.hex(f"d{i}") for i in range(4)))


def table_fingerprint(df: DataFrame) -> DataFrame:
    """Count and an order-free digest of a table's rows; the sum sees rows that come twice, which the xor alone would not."""
    h = F.xxhash64(*df.columns)
    total = F.sum(h.cast("decimal(38,0)")).cast("string")
    return df.agg(F.count("*").alias("rows"), F.concat_ws(":", F.bit_xor(h).cast("string"), total).alias("digest"))


def files_with_sessions(files: DataFrame, sessions: DataFrame) -> DataFrame:
    """Known files with their session's columns, null where a file gave none."""
    own = sessions.select("session_key", "native_session_id", "message_count", "title")
    return files.withColumnRenamed("session_key", "wanted").join(own, F.col("wanted") == F.col("session_key"), "left").drop("wanted")


def scope_messages(sessions: DataFrame, predicate: Column) -> DataFrame:
    """Messages that a search of this scope looks through."""
    return sessions.where(predicate).agg(F.coalesce(F.sum("message_count"), F.lit(0)).alias("scanned_message_count"))
