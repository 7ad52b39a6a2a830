"""Incremental sync as joins: what changed, what it becomes, what goes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.storage import shared_path

#: Version of the projection; rows of another version are projected again.
EPOCH = 1


def classify_files(scan: DataFrame, state: DataFrame) -> DataFrame:
    """Scanned files with an action against the stored state.

    unchanged: nothing differs.  refresh: only the time does, the bytes are the same.
    append: the stored bytes are a prefix of the file.  full: anything else.
    ``scan``: source_id, file_path, size, mtime_ms, cwd, path_date, content_sha, prefix_sha
    (digest of as many bytes as the state has); ``state``: the same with s_ names.
    """
    j = scan.join(state, ["source_id", "file_path"], "left")
    known = F.col("s_size").isNotNull() & (F.col("s_epoch") == EPOCH)
    same_place = F.col("cwd").eqNullSafe(F.col("s_cwd")) & F.col("path_date").eqNullSafe(F.col("s_path_date"))
    same_bytes = (F.col("size") == F.col("s_size")) & (F.col("content_sha") == F.col("s_content_sha")) & same_place
    grown = (F.col("size") > F.col("s_size")) & (F.col("prefix_sha") == F.col("s_content_sha"))
    action = F.when(known & same_bytes & (F.col("mtime_ms") == F.col("s_mtime_ms")), "unchanged").when(known & same_bytes, "refresh").when(known & grown, "append").otherwise("full")
    reason = F.when(F.col("s_size").isNull(), "new_file").when(F.col("s_epoch") != EPOCH, "epoch_changed").when(F.col("size") < F.col("s_size"), "truncated").when(F.col("size") == F.col("s_size"), "rewritten").otherwise("prefix_changed")
    return j.withColumns({"action": action, "reason": F.when(action == "full", reason)})


#: What rules out that a source stayed as it was, first of all what weighs most.
REJECTED = ("source_file_set_changed", "non_codex_source_changed", "source_not_append_only", "projected_prefix_not_proven")


def file_transitions(before: DataFrame, after: DataFrame, proofs: DataFrame) -> DataFrame:
    """(source_id, file_path, state) of all files at two looks: same, append, defer, or one of ``REJECTED``.

    Files: source_id, file_path, size, mtime_ms; ``proofs``: file_path (and source_id), prefix_matches, was_indexed, projected.
    """
    b = before.select("source_id", "file_path", F.col("size").alias("b_size"), F.col("mtime_ms").alias("b_time"))
    a = after.select("source_id", "file_path", F.col("size").alias("a_size"), F.col("mtime_ms").alias("a_time"))
    on = [c for c in ("source_id", "file_path") if c in proofs.columns]
    j = b.join(a, ["source_id", "file_path"], "full").join(proofs, on, "left")
    changed = (F.col("b_size") != F.col("a_size")) | (F.col("b_time") != F.col("a_time"))
    proven, done = F.coalesce("prefix_matches", F.lit(False)), F.coalesce("projected", F.lit(False))
    state = (
        F.when(F.col("b_size").isNull() | F.col("a_size").isNull(), "source_file_set_changed").when(~changed, "same").when(F.col("source_id") != "codex", "non_codex_source_changed")
        .when(F.col("a_size") <= F.col("b_size"), "source_not_append_only").when(done & ~proven, "projected_prefix_not_proven").when(done & ~F.coalesce("was_indexed", F.lit(False)), "defer").when(~proven, "defer").otherwise("append")
    )
    return j.select("source_id", "file_path", state.alias("state"))


def verdicts(states: DataFrame) -> DataFrame:
    """Per source kind (stable, append_only, deferred, rejected) and reason."""
    s = states.groupBy("source_id").agg(F.collect_set("state").alias("states"))  # seven states at most
    why = F.get(F.filter(F.array(*map(F.lit, REJECTED)), lambda r: F.array_contains("states", r)), F.lit(0))
    kind = F.when(why.isNotNull(), "rejected").when(F.array_contains("states", "defer"), "deferred").when(F.array_contains("states", "append"), "append_only").otherwise("stable")
    reason = F.coalesce(why, F.when(kind == "deferred", "active_source_deferred").when(kind == "append_only", "source_content_changed"))
    return s.select("source_id", kind.alias("kind"), reason.alias("reason"))


def transition(before: DataFrame, after: DataFrame, proofs: DataFrame) -> DataFrame:
    """Per source: did its files stay put between two looks, and which of them are deferred; a list, for small sources."""
    states = file_transitions(before, after, proofs)
    waiting = states.where("state = 'defer'").groupBy("source_id").agg(F.sort_array(F.collect_list("file_path")).alias("waiting"))
    none = F.array().cast("array<string>")
    deferred = F.when(F.col("kind") == "rejected", none).otherwise(F.coalesce("waiting", none))
    return verdicts(states).join(waiting, "source_id", "left").select("source_id", "kind", "reason", deferred.alias("deferred"))


def same_file_sets(before: DataFrame, after: DataFrame) -> DataFrame:
    """(source_id, same): does a source have the same files at both looks?"""
    a, b = (df.select("source_id", "file_path") for df in (before, after))
    moved = a.exceptAll(b).unionByName(b.exceptAll(a)).select("source_id").distinct().withColumn("same", F.lit(False))
    sources = a.unionByName(b).select("source_id").distinct()
    return sources.join(moved, "source_id", "left").withColumn("same", F.coalesce("same", F.lit(True)))


def prune(sessions: DataFrame, hot_paths: DataFrame, cold: DataFrame) -> DataFrame:
    """Sessions with what becomes of them: kept (file is there), retained_cold (archived), removed."""
    hot, arch = hot_paths.select("source_id", "file_path").distinct().withColumn("hot", F.lit(True)), cold.select("native_session_id").distinct().withColumn("cold", F.lit(True))
    j = sessions.join(hot, ["source_id", "file_path"], "left").join(arch, "native_session_id", "left")
    fate = F.when(F.col("hot"), "kept").when(F.col("cold") & (F.col("source_id") == "codex"), "retained_cold").otherwise("removed")
    return j.withColumn("fate", fate).drop("hot", "cold")


def replace_sessions(old: DataFrame, new: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of the touched sessions (keys: session_key) come from ``new``, all others stay."""
    return old.join(keys.select("session_key").distinct(), "session_key", "left_anti").unionByName(new)


def report(actions: DataFrame) -> DataFrame:
    """Counts per source of a sync's outcomes."""
    n = lambda *names: F.count_if(F.col("action").isin(*names))
    return actions.groupBy("source_id").agg(F.count("*").alias("scanned"), F.count_if(F.col("reason") == "new_file").alias("added"), F.count_if((F.col("action").isin("full", "append")) & ~F.col("reason").eqNullSafe("new_file")).alias("updated"), n("unchanged", "refresh").alias("skipped"))


def publish(tables: dict[str, DataFrame], base: str, violations: DataFrame | None = None) -> str:
    """Writes a version of the tables and then the pointer to it; returns the version's path.

    Readers follow the newest pointer, so a failed write leaves the old version in
    force.  Rows in ``violations`` stop the publication.
    """
    spark = next(iter(tables.values())).sparkSession
    if violations is not None and not violations.isEmpty():
        raise ValueError("the tables break their rules; nothing was published")
    name = shared_path(spark).rpartition("/")[2]
    for table, df in tables.items():
        (df.write.partitionBy("source_id") if "source_id" in df.columns else df.write).parquet(f"{base}/versions/{name}/{table}")
    spark.range(1).select(F.lit(name).alias("version"), F.current_timestamp().alias("published_at")).coalesce(1).write.mode("append").parquet(f"{base}/current")
    return f"{base}/versions/{name}"


def current(spark, base: str) -> str:
    """Path of the version in force."""
    return f"{base}/versions/" + spark.read.parquet(f"{base}/current").orderBy(F.desc("published_at"), F.desc("version")).first()["version"]


def add_cold_roots(registry: DataFrame, new: DataFrame) -> DataFrame:
    """Registry (source_id, root, added_at) with new roots; a known root keeps its first date."""
    return registry.unionByName(new).groupBy("source_id", "root").agg(F.min("added_at").alias("added_at"))


def remove_cold_roots(registry: DataFrame, gone: DataFrame) -> DataFrame:
    return registry.join(gone.select("source_id", "root"), ["source_id", "root"], "left_anti")
