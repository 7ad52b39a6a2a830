"""Rules that published tables keep, as a table of violations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.operators import selectors
from quarryline.plans.corpora import SOURCES


def violations(sessions: DataFrame, documents: DataFrame, doc_stats: DataFrame | None = None, files: DataFrame | None = None, coverage: DataFrame | None = None) -> DataFrame:
    """(rule, key, detail) of every broken rule; empty if all hold."""
    message, profile = F.col("kind") == "message", F.col("kind") == "session_profile"
    per = documents.groupBy("session_key").agg(
        F.count_if(message).alias("m"), F.count_if(profile).alias("p"), F.count("*").alias("d"), F.min(F.when(message, F.col("seq"))).alias("lo"), F.max(F.when(message, F.col("seq"))).alias("hi"),
        F.countDistinct(F.when(message, F.col("seq"))).alias("seqs"),
        F.first(F.when(profile, F.struct("title_text", "summary_text", "compact_text", "reasoning_text")), ignorenulls=True).alias("shown"),
        F.count_if(~F.col("kind").isin("message", "session_profile") | (message & (F.col("role").isNull() | ~F.col("role").isin("user", "assistant")))).alias("odd"),
    )
    j = sessions.join(per, "session_key", "left").fillna(0, ["m", "p", "d", "odd", "seqs"])
    mirror = F.struct(F.col("title").alias("title_text"), "summary_text", "compact_text", F.col("reasoning_summary_text").alias("reasoning_text"))
    rules = {
        "unknown_source": ~F.col("source_id").isin(*SOURCES),
        "noncanonical_key": F.col("session_key") != F.concat_ws(":", "source_id", "native_session_id"),
        "message_count": F.col("message_count") != F.col("m"),
        "document_count": F.col("document_count") != F.col("d"),
        "profile_count": F.col("p") != 1,
        "sequence": (F.col("m") > 0) & ((F.col("lo") != 0) | (F.col("hi") != F.col("m") - 1) | (F.col("seqs") != F.col("m"))),
        "profile_mirror": F.coalesce(F.col("shown") != mirror, F.lit(False)),
        "kind_or_role": F.col("odd") > 0,
    }
    broken = F.filter(F.array(*(F.when(hit, name) for name, hit in rules.items())), lambda x: x.isNotNull())
    out = j.select(F.explode(broken).alias("rule"), F.col("session_key").alias("key"), F.concat_ws("/", F.col("m").cast("string"), F.col("p").cast("string"), F.col("d").cast("string")).alias("detail"))
    orphans = documents.join(sessions.select("session_key"), "session_key", "left_anti")
    out = out.unionByName(orphans.select(F.lit("orphan_document").alias("rule"), F.col("doc_id").alias("key"), F.col("session_key").alias("detail")))
    twice = sessions.groupBy("session_key").count().where("count > 1")
    out = out.unionByName(twice.select(F.lit("duplicate_session").alias("rule"), F.col("session_key").alias("key"), F.col("count").cast("string").alias("detail")))
    if doc_stats is not None:
        d, s = documents.select("doc_id"), doc_stats.select("doc_id")
        for rule, rows in (("not_indexed", d.join(s, "doc_id", "left_anti")), ("index_without_document", s.join(d, "doc_id", "left_anti"))):
            out = out.unionByName(rows.select(F.lit(rule).alias("rule"), F.col("doc_id").alias("key"), F.lit("").alias("detail")))
    if files is not None:
        bad = files.where("indexed_bytes > size or next_seq < 0 or (indexed_bytes > 0 and prefix_sha = '')")
        stale = files.join(sessions.select("session_key", "message_count"), "session_key").where("indexed_bytes > 0 and next_seq <> message_count")
        for rule, rows in (("bad_cursor", bad), ("stale_next_seq", stale)):
            out = out.unionByName(rows.select(F.lit(rule).alias("rule"), F.col("file_path").alias("key"), F.col("next_seq").cast("string").alias("detail")))
    if coverage is not None:
        c = coverage.withColumn("c", selectors.canonical(F.col("selector_json")))
        bad = c.where("c.error is not null").select(F.lit("coverage_selector").alias("rule"), F.col("selector_key").alias("key"), F.col("c.error").alias("detail"))
        odd = c.where(selectors.storage_key(F.col("c.selector")) != F.col("selector_key")).select(F.lit("coverage_key").alias("rule"), F.col("selector_key").alias("key"), F.lit("").alias("detail"))
        out = out.unionByName(bad).unionByName(odd)
    return out


def bad_messages(rows: DataFrame) -> DataFrame:
    """Message rows that may not be written, with the rule each breaks."""
    rule = (
        F.when(F.coalesce("session_key", F.lit("")) == "", "session_key").when(~F.col("role").isin("user", "assistant") | F.col("role").isNull(), "role").when(F.col("seq").isNull() | (F.col("seq") < 0), "seq")
        .when(F.coalesce("body_text", F.lit("")) == "", "body_text").when(F.col("raw_start").isNotNull() & ((F.col("raw_start") < 0) | (F.col("raw_end") < F.col("raw_start"))), "offsets")
    )
    return rows.withColumn("rule", rule).where("rule is not null")


def compare_copies(tables: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(table, rows_before, rows_after, changed) of tables and their copies, by count and order-free digests."""
    from quarryline.operators.catalog import table_fingerprint

    out = None
    for name, (before, after) in tables.items():
        old, new = (table_fingerprint(df.select(*sorted(before.columns))) for df in (before, after))
        old = old.select(F.lit(name).alias("table"), F.col("rows").alias("rows_before"), F.col("digest").alias("was"))
        pair = old.crossJoin(F.broadcast(new.select(F.col("rows").alias("rows_after"), F.col("digest").alias("is"))))  # one row
        row = pair.select("table", "rows_before", "rows_after", (F.col("was") != F.col("is")).alias("changed"))
        out = row if out is None else out.unionByName(row)
    return out


def differing_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows that only one of two tables has, with ``side``; repeated rows count as often as they come."""
    columns = before.columns
    only = lambda a, b, side: a.select(*columns).exceptAll(b.select(*columns)).withColumn("side", F.lit(side))
    return only(before, after, "before").unionByName(only(after, before, "after"))


def epoch_gate(meta: DataFrame) -> DataFrame:
    """Adds readable (same content version) and coverage_shown (same coverage version too); rows: index_version, coverage_epoch."""
    from quarryline.operators.project import INDEX_VERSION
    from quarryline.operators.sync import EPOCH

    readable = F.col("index_version") == INDEX_VERSION
    return meta.withColumns({"readable": readable, "coverage_shown": readable & (F.col("coverage_epoch") == EPOCH)})


def copy_legacy(sessions: DataFrame, messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sessions and documents from the older layout of sessions and messages, without the raw files.

    Older rows: sessions (session_uuid, ...), messages (session_uuid, seq, role, content_text, timestamp).
    """
    from quarryline.operators.project import INDEX_VERSION, build_documents

    s = sessions.withColumns({"source_id": F.coalesce("source_id", F.lit("codex")), "native_session_id": F.regexp_replace("session_uuid", "^(codex|claude-code|pi|dsh):", "")})
    s = s.withColumns({"session_key": F.concat_ws(":", "source_id", "native_session_id"), "index_version": F.lit(INDEX_VERSION)})
    m = messages.join(s.select("session_uuid", "session_key", "source_id"), "session_uuid").withColumnRenamed("content_text", "body_text")
    counts = m.groupBy("session_key").agg(F.count("*").alias("message_count"))
    s = s.drop("message_count", "document_count").join(counts, "session_key", "left").fillna(0, ["message_count"]).withColumn("document_count", F.col("message_count") + 1)
    return s, build_documents(m, s)
